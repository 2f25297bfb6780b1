"""Union-find inside one task, over the few vertices of one tile pair."""

from __future__ import annotations

import numpy as np


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n vertices and links a[i]-b[i]: the smallest vertex that each one reaches, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
