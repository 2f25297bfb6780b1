"""Hashes of any substring of a byte buffer from one pass of prefix sums."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x2127599BF4325C37


def mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


@lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))


class Rolling:
    """Polynomial hashes modulo 2^64; equal bytes have equal hashes in every buffer. Never proof of equality by themselves."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _tables(1 << int(n).bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        """Mixed hashes of all substrings of `size` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])
