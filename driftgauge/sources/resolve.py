"""Which columns of a table are features, and which one orders it in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Naming rules of replay tables.
FEATURE_PREFIXES = ("feature_", "f_")
TIME_COLUMNS = ("time_rank", "TransactionDT", "step")


def feature_columns(df: DataFrame, prefixes: Sequence[str] = FEATURE_PREFIXES,
                    exclude: Sequence[str] = ("timestamp", "label")) -> list[str]:
    """Columns named like features; without any, all numeric columns not excluded."""
    named = [c for c in df.columns if c.startswith(tuple(prefixes))]
    if named:
        return named
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def features_array(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.array(*[F.col(c).cast("double") for c in (columns or feature_columns(df))])


def time_column(df: DataFrame) -> str | None:
    """The first known time column; without one the caller has to name an order key."""
    return next((c for c in TIME_COLUMNS if c in df.columns), None)
