"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search."""

from __future__ import annotations

import numpy as np

from .common import runs


def _refined(first_key: np.ndarray, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``most`` symbols at least; first_key orders them by ``depth`` symbols.

    Every round sorts the still equal groups alone, by the rank of the suffix ``depth`` further on, and
    doubles ``depth``: groups that are settled are never touched again.
    """
    n = len(first_key)
    sa = np.argsort(first_key)  # the order of equal keys is of no concern: the faster sort
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts, ends = runs(first_key[sa])
    rank[sa] = np.repeat(starts, ends - starts)
    at = np.flatnonzero(np.repeat(ends - starts > 1, ends - starts))
    while len(at) and depth < most:
        own = sa[at]
        key = rank[own] * (n + 2) + rank[np.minimum(own + depth, n)] + 1
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[at] = own
        starts, ends = runs(key)
        rank[own] = np.repeat(at[starts], ends - starts)
        at = at[np.repeat(ends - starts > 1, ends - starts)]
        depth *= 2
    return sa, rank[:n]


def byte_keys(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros past the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(len(data), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + len(data)].astype(np.uint64)
    return key


def of_bytes(data: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of a byte array; equal ranks only where ``most`` symbols agree."""
    return _refined(byte_keys(data), 8, most or len(data))


def of_tokens(tokens: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``of_bytes`` for an array of non-negative token numbers below 2^31."""
    wide = tokens.astype(np.int64)
    key = wide << 32 | np.append(wide[1:] + 1, 0) if len(wide) else wide
    return _refined(key, 2, most or len(tokens))


def kasai(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """``out[i]``: common prefix of suffixes ``sa[i-1]`` and ``sa[i]``, counted up to ``most``; out[0] is 0.

    Kasai's inequality says that a suffix shares with its predecessor at least one symbol less than its left
    neighbour does. Positions are taken level by level, at halving distances, so that all of a level are
    compared at once: a position's prefix is at least that of the known one on its left less their distance
    and at most that of the one on its right plus it. Where both agree nothing is compared; elsewhere
    comparison starts at the lower bound, eight bytes at a time.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    words = np.concatenate((byte_keys(data), np.zeros(1, np.uint64)))
    room = np.minimum(n - np.maximum(np.arange(n), before), most)
    known = np.full(n, -1, np.int64)
    step = 1 << (most - 1).bit_length()
    level = np.arange(0, n, step)
    while True:
        left, right = level - step, level + step
        low = np.where((left >= 0) & (known[np.maximum(left, 0)] >= 0), known[np.maximum(left, 0)] - step, 0)
        beside = np.minimum(right, n - 1)
        high = np.where((right < n) & (known[beside] >= 0) & (known[beside] < most), known[beside] + step, most)
        low, high = np.clip(low, 0, room[level]), np.minimum(high, room[level])
        at = np.flatnonzero(low < high)
        while len(at):
            i = level[at]
            differ = words[i + low[at]] ^ words[np.minimum(before[i] + low[at], n)]
            equal = np.where(differ == 0, 8, (63 - _top_bit(differ)) >> 3)
            low[at] = np.minimum(low[at] + equal, high[at])
            at = at[(equal == 8) & (low[at] < high[at])]
        known[level] = low
        if step == 1:
            break
        step >>= 1
        level = np.arange(step, n, 2 * step)
    return known[sa]


def _top_bit(x: np.ndarray) -> np.ndarray:
    """Number of the highest set bit; 0 for 0."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(shift)
    return np.maximum(np.bitwise_count(x).astype(np.int64) - 1, 0)


def bounds(tokens: np.ndarray, sa: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query row, the stretch of ``sa`` whose suffixes begin with its first ``lengths`` tokens."""
    n, m = len(sa), len(queries)
    padded = np.concatenate((tokens, np.full(queries.shape[1] + 1, -1, tokens.dtype)))

    def search(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        for _ in range(n.bit_length()):
            live = lo < hi
            mid = (lo + hi) >> 1
            at = sa[np.minimum(mid, n - 1)]
            side = np.zeros(m, np.int8)
            open_ = np.flatnonzero(live)
            for k in range(queries.shape[1]):
                open_ = open_[lengths[open_] > k]
                if not len(open_):
                    break
                have, want = padded[at[open_] + k], queries[open_, k]
                side[open_] = np.sign(have - want)
                open_ = open_[have == want]
            right = (side < 0) | (upper & (side == 0))
            lo = np.where(live & right, mid + 1, lo)
            hi = np.where(live & ~right, mid, hi)
        return lo

    return search(False), search(True)
