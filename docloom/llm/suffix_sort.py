"""Sorting of suffixes by hash-compared mergesort, for many small groups at once."""

from __future__ import annotations

import numpy as np

from docloom.llm.bytes_hash import PrefixHash


def common_extension(hashes: PrefixHash, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes the suffixes at x and y share, up to ``limit``: a binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    while len(x) and (low < high).any():
        middle = (low + high + 1) >> 1
        same = hashes.of(x, middle) == hashes.of(y, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _before(hashes: PrefixHash, whole: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray, limit: int, ties: np.ndarray) -> np.ndarray:
    """Whether suffix x sorts before suffix y; equal ones as ``ties`` says."""
    out = ties.copy()
    differ = np.flatnonzero(whole[x] != whole[y])
    a, b = starts[x[differ]], starts[y[differ]]
    shared = np.minimum(common_extension(hashes, a, b, limit), limit - 1)
    out[differ] = hashes.data[a + shared] < hashes.data[b + shared]
    return out


def sort_suffixes(hashes: PrefixHash, starts: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes by group and then by their first ``limit`` bytes.

    ``groups`` must be ascending.  A bottom-up mergesort in which all merges of a level run
    together: each element finds its rank in the sibling run by binary search.  Every start
    must have ``limit`` bytes after it.
    """
    order = np.arange(len(starts))
    if not len(starts):
        return order
    whole = hashes.of(starts, limit)
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(first, len(groups)))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        active = np.flatnonzero(size > width)
        own = active - begin[active]
        run = own // width
        odd = run & 1
        low = begin[active] + np.minimum((run ^ 1) * width, size[active])
        high = begin[active] + np.minimum(((run ^ 1) + 1) * width, size[active])
        sibling = low.copy()
        x = order[active]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            # Of equal suffixes those of the even run come first.
            less = _before(hashes, whole, order[middle], x[open_], starts, limit, odd[open_].astype(bool))
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        place = begin[active] + (run - odd) * width + (own - run * width) + (low - sibling)
        order[place] = x
        width *= 2
    return order


def repeated(hashes: PrefixHash, starts: np.ndarray, groups: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix whether another of its group has the same first ``limit`` bytes.

    Equal strings are neighbours in suffix order; a neighbour whose common extension reaches
    the limit is compared byte by byte, so that a hash collision removes nothing.
    """
    order = sort_suffixes(hashes, starts, groups, limit)
    x, y = order[:-1], order[1:]
    near = np.flatnonzero((groups[x] == groups[y]) & (hashes.of(starts[x], limit) == hashes.of(starts[y], limit)))
    out = np.zeros(len(starts), bool)
    for k in range(0, len(near), 1 << 15):
        own = near[k:k + (1 << 15)]
        span = np.arange(limit)
        equal = (hashes.data[starts[x[own]][:, None] + span] == hashes.data[starts[y[own]][:, None] + span]).all(axis=1)
        out[x[own[equal]]] = True
        out[y[own[equal]]] = True
    return out
