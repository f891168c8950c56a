"""Suffix arrays of byte strings by numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of the bytes that follow; an end comes before any byte.

    Refinement after Larsson and Sadakane: positions are sorted by seven bytes; then those in groups that are
    still tied are sorted by the group of the position h further on, and h doubles until no group is left.
    Groups of one are left alone.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    first = np.zeros(n, np.uint64)
    for k in range(7):
        first = (first << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(first, kind="stable")
    change = np.ones(n, dtype=bool)
    change[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(change)[np.cumsum(change) - 1]
    rank[n] = -1
    h = 7
    while True:
        last = np.append(change[1:], True)
        tied = np.flatnonzero(~(change & last))
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at] << np.int64(32)) | (rank[np.minimum(at + h, n)] + 1)
        sort = np.argsort(key, kind="stable")
        order[tied], key = at[sort], key[sort]
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        change[tied] = fresh
        rank[order[tied]] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes, up to ``limit``, each position of ``order`` has in common with the one before it.

    After Kasai: going through the text, the common prefix of a position is at most one shorter than that of the
    position before. The chains begin at ``starts``, go on to the next start, and advance together.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    common = np.zeros(n, np.int16)
    ends = np.append(starts[1:], n)
    size = ends - starts
    by_size = np.argsort(-size, kind="stable")
    starts, size = starts[by_size], size[by_size]
    held = np.zeros(len(starts), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))  # chains longer than the step
        here = starts[:live] + step
        other = before[here]
        h = np.where(other < 0, 0, np.maximum(held[:live] - 1, 0))
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b, c = here[going], other[going], h[going]
            fits = (np.maximum(a, b) + c < n) & (c < limit)
            going, a, b, c = going[fits], a[fits], b[fits], c[fits]
            same = text[a + c] == text[b + c]
            going = going[same]
            h[going] += 1
        common[here] = h
        held[:live] = h
    return common[order]
