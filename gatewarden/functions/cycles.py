"""Windows of a sequence that are one cycle over and over."""

from __future__ import annotations

import numpy as np


def stretches_equal(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``values[a : a + size]`` is ``values[b : b + size]``, for many places at once.

    Stretches of 1, 2, 4, ... values are ranked, each size from the one before; two of the largest size that
    fits, which may overlap, cover a stretch. So equality is exact and the cost does not depend on the sizes.
    """
    out = np.ones(len(size), dtype=bool)
    if not size.any():
        return out
    low = min(a.min(), b.min())
    rank, a, b, width = np.unique(values[low : (np.maximum(a, b) + size).max()], return_inverse=True)[1], a - low, b - low, 1
    while True:
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        x, y, rest = a[at], b[at], size[at] - width
        out[at] = (rank[x] == rank[y]) & (rank[x + rest] == rank[y + rest])
        if not (size >= 2 * width).any():
            return out
        rank = np.unique(rank[:-width] * (rank.max() + 1) + rank[width:], return_inverse=True)[1]
        width *= 2


def cyclic(values: np.ndarray, since: np.ndarray, least_distinct: int, least: int) -> np.ndarray:
    """Whether the window of each row, from the row ``since`` to itself, is a cycle that is there twice or more.

    ``since`` never decreases. The cycle ends with the last value that is new in the window; what follows the
    last whole cycle does not count. No row looks at its window: a value is new from the row on whose window
    leaves its occurrence before out, and the last new one is the greatest so far.
    """
    n = len(values)
    row, order = np.arange(n), np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    new = np.maximum(row, np.searchsorted(since, before, "right"))
    there = new < n
    last = np.zeros(n, dtype=row.dtype)
    np.maximum.at(last, new[there], row[there])
    last = np.maximum.accumulate(last)
    distinct = np.cumsum(np.bincount(new[there], minlength=n)) - since  # values before the window were all new once
    length, size = row - since + 1, last - since + 1
    whole = length // size
    # in a cycle, its last value comes next a cycle later
    hit = (distinct >= least_distinct) & (length >= least) & (whole >= 2) & (after[last] == last + size)
    c = np.flatnonzero(hit)
    hit[c] = stretches_equal(values, since[c], since[c] + size[c], size[c] * (whole[c] - 1))
    return hit
