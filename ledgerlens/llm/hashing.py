"""Hashes of words in numpy."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _tables[base] = np.cumprod(table)
    return _tables[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; different values stay different."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; equal bytes have equal hashes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(data)), out=total[1:])
    back = _powers(pow(_ODD, -1, 1 << 64), max(len(data), 1))
    return mixed((total[ends] - total[starts]) * back[starts])
