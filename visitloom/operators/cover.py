"""Which interval to take, for the points and intervals that one task holds: sorted arrays, no pairs.

Helpers of operators.ranges. Work grows with n log n of a bucket's rows, however many of them meet.
"""

from __future__ import annotations

import numpy as np


def covered(point_codes, at, span_codes, lo, hi) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points, and the run of it, from first to before last, that each span holds.

    A span holds points of its own code from ``lo`` to ``hi``.
    """
    times = np.unique(at)
    wide = len(times) + 1
    key = point_codes * wide + np.searchsorted(times, at)
    order = np.argsort(key, kind="stable")
    first = np.searchsorted(key[order], span_codes * wide + np.searchsorted(times, lo, "left"))
    last = np.searchsorted(key[order], span_codes * wide + np.searchsorted(times, hi, "right"))
    return order, first, last


def painted(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each of n places the last of the spans, in their order, whose run holds it; else -1.

    A run is entered as two overlapping runs of a power of two; these are handed down, halved each time.
    """
    told = np.full((max(int(n), 1).bit_length(), n), -1, dtype=np.int64)
    span = np.flatnonzero(last > first)
    level = np.frexp((last - first)[span])[1] - 1
    np.maximum.at(told, (level, first[span]), span)
    np.maximum.at(told, (level, last[span] - (1 << level)), span)
    for k in range(len(told) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(told[k - 1], told[k], out=told[k - 1])
        np.maximum(told[k - 1][half:], told[k][:-half], out=told[k - 1][half:])
    return told[0]


def rightmost(values: np.ndarray, upto: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each question the highest place below ``upto`` whose value is at least ``least``; else -1."""
    tree = [values]
    while len(tree[-1]) > 1:
        below = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], tree[-1][-1])
        tree.append(np.maximum(below[::2], below[1::2]))
    node, level = np.full(len(upto), -1, dtype=np.int64), np.full(len(upto), -1)
    for k, most in enumerate(tree):
        block = (upto >> k) - 1
        ask = np.flatnonzero((level < 0) & ((upto >> k) & 1 == 1))
        ask = ask[most[block[ask]] >= least[ask]]
        node[ask], level[ask] = block[ask], k
    for k in range(len(tree) - 1, 0, -1):
        ask = np.flatnonzero(level >= k)
        right = np.minimum(2 * node[ask] + 1, len(tree[k - 1]) - 1)
        node[ask] = np.where(tree[k - 1][right] >= least[ask], right, 2 * node[ask])
    return node


def best_below(values: np.ndarray, rank: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each question the highest rank of the places from ``begin`` to before ``end`` whose value is below ``limit``; else -1.

    Places are cut in aligned blocks of each power of two, ordered by value within a block; a question
    looks into at most two blocks a level.
    """
    n, best = len(values), np.full(len(begin), -1, dtype=np.int64)
    steps = np.unique(values)
    wide, step, limit = len(steps) + 1, np.searchsorted(steps, values), np.searchsorted(steps, limit)
    lo, hi, k = begin.copy(), np.maximum(begin, end), 0
    while (lo < hi).any():
        block = np.arange(n) >> k
        key = block * wide + step
        order = np.argsort(key, kind="stable")
        key, block = key[order], block[order]
        running = np.maximum.accumulate(block * n + rank[order])
        for ask, node in (((lo < hi) & (lo & 1 == 1), lo), ((lo < hi) & (hi & 1 == 1), hi - 1)):
            q = np.flatnonzero(ask)
            at = np.searchsorted(key, node[q] * wide + limit[q]) - 1
            q, at = q[at >= 0], at[at >= 0]
            q, at = q[block[at] == node[q]], at[block[at] == node[q]]
            best[q] = np.maximum(best[q], running[at] - block[at] * n)
        lo, hi, k = (lo + 1) >> 1, hi >> 1, k + 1
    return best


def longest_overlap(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval a to b the span that it overlaps longest, the last such in the order of spans; else -1.

    Spans are sorted by ``lo``. Those around the interval come first. Else the best of: those that begin
    before it, by their end; those that end after it, by their start; those within, by their length.
    """
    n, place = len(lo), np.arange(len(lo))
    upto = np.searchsorted(lo, a, "right")
    told = rightmost(hi, upto, b)
    left = np.flatnonzero(told < 0)
    a, b, upto = a[left], b[left], upto[left]
    best, length = np.full(len(left), -1, dtype=np.int64), np.zeros(len(left), dtype=np.result_type(a, b, lo, hi))

    def take(span: np.ndarray, meets: np.ndarray) -> None:
        overlap = np.minimum(b, hi[span]) - np.maximum(a, lo[span])
        better = meets & ((best < 0) | (overlap > length) | ((overlap == length) & (span > best)))
        best[better], length[better] = span[better], overlap[better]

    by_end = np.lexsort((place, hi))
    rank = np.empty(n, dtype=np.int64)
    rank[by_end] = place
    before = by_end[np.maximum.accumulate(rank)][np.maximum(upto - 1, 0)]
    take(before, (upto > 0) & (hi[before] >= a))
    by_start = np.lexsort((place, -lo))  # the earliest start is the highest rank
    rank[by_start] = place
    ends_later = np.searchsorted(hi[by_end], b, "left")
    after = by_start[np.maximum.accumulate(rank[by_end][::-1])[::-1]][np.minimum(ends_later, n - 1)]
    take(after, (ends_later < n) & (lo[after] <= b))
    by_length = np.lexsort((place, hi - lo))
    rank[by_length] = place
    within = best_below(hi, rank, upto, np.searchsorted(lo, b, "right"), b)
    take(by_length[np.maximum(within, 0)], within >= 0)
    told[left] = best
    return told
