"""Suffix arrays by linear grouping (no recursion, no renaming).

Phase 1 groups suffixes by their longest Lyndon prefix. Groups are taken in descending
order; for each suffix the previous-smaller pointer (the nearest earlier suffix of a lower
group) is found, and the suffixes pointed to move, most pointers first, into new groups
right above their old ones. Phase 2 emits the order: taking suffixes in order, each places
its left neighbour, and from there along the pointers, at the front of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (non-negative integers)."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)  # closed by a unique smallest symbol
    text[:-1] = np.asarray(symbols, np.int64) + 1
    order = np.argsort(text, kind="stable")
    first = np.flatnonzero(np.diff(text[order], prepend=-1))
    sizes = np.diff(first, append=n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, sizes)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    size_at = np.zeros(n + 1, np.int64)
    size_at[first] = sizes
    sa, at, start, size = order.tolist(), rank.tolist(), group.tolist(), size_at.tolist()
    prev = [-1] * n

    end = n - 1
    while end > 0:
        low = start[sa[end]]
        if low == end:  # one suffix
            s = sa[end]
            p = s - 1
            while p >= 0 and start[p] > low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                g = start[p]
                t = g + size[g] - 1
                if t != g:
                    i, x = at[p], sa[t]
                    sa[i], sa[t] = x, p
                    at[x], at[p] = i, t
                    size[g] -= 1
                    size[t] = 1
                    start[p] = t
        else:
            hits: dict[int, int] = {}
            for s in sorted(sa[low : end + 1]):
                p = s - 1
                while p >= 0 and start[p] > low:
                    p = prev[p]
                if p >= 0 and start[p] == low:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, c in hits.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved = by_count[c]
                olds = []
                for p in moved:
                    g = start[p]
                    t = g + size[g] - 1
                    i, x = at[p], sa[t]
                    sa[i], sa[t] = x, p
                    at[x], at[p] = i, t
                    size[g] -= 1
                    olds.append(g)
                for g in set(olds):
                    if size[g]:
                        size[g + size[g]] = 0
                for p, g in zip(moved, olds):
                    start[p] = g
                tops = {g: g + size[g] for g in set(olds)}
                for p, g in zip(moved, olds):
                    t = tops[g]
                    start[p] = t
                    size[t] += 1
        end = low - 1

    out, front, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = prev[s]
    return np.array(out[1:], np.int64)
