"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module of this package and return (queries, oracles)."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    from driftgauge.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
