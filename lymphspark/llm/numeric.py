"""Array kernels that the similarity operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    z = x.astype(np.uint64) + _M(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _M(27))) * _M(0x94D049BB133111EB)
    return z ^ (z >> _M(31))


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def position_in_run(starts: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def pairs_in_runs(pos: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), j before i in the same run; pos is each row's position in its run. At most about ``most`` at once."""
    ends = np.cumsum(pos)
    lo = 0
    while lo < len(pos):
        base = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, base + most, "right")), lo + 1)
        count = pos[lo:hi]
        total = int(count.sum())
        if total:
            i = np.repeat(np.arange(lo, hi), count)
            back = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            yield i, i - 1 - back
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the links a-b: every node, and the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[join(np.arange(len(nodes)), at[: len(a)], at[len(a) :])]


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of components by their least member, those that arise when x and y (as indices) are linked as well."""
    while True:
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            return label
        x, y = x[open_], y[open_]
        low, high = np.minimum(lx, ly)[open_], np.maximum(lx, ly)[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
