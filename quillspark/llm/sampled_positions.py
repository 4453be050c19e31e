"""Positions of a byte string that content alone chooses, and the names of the strings that start there.

A helper of suffix_dedup, per document and in numpy.
"""

from __future__ import annotations

import numpy as np

#: Bytes in the grams whose least hash marks a window.
GRAM = 8
#: Windows handled at a time, so that a long text takes no more memory.
SEGMENT = 1 << 20

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    return _UP[:n], _DOWN[:n]


class Names:
    """64-bit names of any substring of at least GRAM bytes: the sum of its grams' hashes, each times a power of a constant."""

    def __init__(self, data: bytes):
        n = len(data) - GRAM + 1
        gram = np.ndarray((n,), "<u8", data, strides=(1,))
        self.hash = gram * _MULTIPLY
        self.hash ^= self.hash >> np.uint64(32)
        self.hash *= np.uint64(0xD6E8FEB86659FD93)
        self.hash ^= self.hash >> np.uint64(29)
        up, self.down = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end - GRAM + 1] - self.sums[start]) * self.down[start]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def marks(names: Names, windows: int, size: int) -> np.ndarray:
    """For each window of `size` bytes the place of its gram of least hash (of equal ones the leftmost): the same for equal windows."""
    place = np.arange(len(names.hash), dtype=np.uint64)
    packed = (names.hash & ~np.uint64((1 << 24) - 1)) | place
    return (_least(packed, size - GRAM + 1)[:windows] & np.uint64((1 << 24) - 1)).astype(np.int64)


def nodes(mark: np.ndarray, first: int, last: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows first..last (inclusive) in runs with one mark whose distance to it is in one class of `width`.

    Returns (from, to, anchor): all windows of a class hold the string from `anchor` to anchor - width + 1 + size.
    """
    s = np.arange(first, last + 1)
    group = (mark[first : last + 1] - s) // width
    new = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(mark[first : last + 1]) != 0)])
    begin = s[new]
    end = np.r_[begin[1:] - 1, last]
    return begin, end, mark[begin] - group[new] * width
