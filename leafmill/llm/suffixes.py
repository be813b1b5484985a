"""Suffix arrays in numpy: Larsson-Sadakane refinement, and common prefixes by Kasai's inequality."""

from __future__ import annotations

import numpy as np


def _sorted_places(high: np.ndarray, bits: int) -> np.ndarray:
    """The order of numbers below 2**bits; one sort of numbers that carry their place, where both fit into 63 bits."""
    room = max(1, (len(high) - 1).bit_length())
    if bits + room > 63:
        return np.argsort(high, kind="stable")
    packed = (high << room) | np.arange(len(high))
    packed.sort()
    return packed & ((1 << room) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of an integer sequence.

    Positions are first ordered by as many symbols as fit into one number. A position's
    rank is the last place of its group. In each round only groups that are not yet single
    are sorted, by the rank `known` symbols further on, and the known length doubles. The
    order is total; common_prefixes relies on that.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    room = max(1, (n - 1).bit_length())
    used, dense = np.unique(symbols, return_inverse=True) if int(symbols.max()) >= 512 or int(symbols.min()) < 0 else _dense(symbols)
    width = max(1, len(used).bit_length())
    known = max(1, min((63 - room) // width, n))
    padded, key = np.concatenate([dense + 1, np.zeros(known, np.int64)]), np.zeros(n, np.int64)
    for j in range(known):
        key = (key << width) | padded[j:n + j]
    sa = _sorted_places(key, known * width)
    ordered = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = ordered[1:] != ordered[:-1]
    group_end = np.flatnonzero(np.append(new[1:], True))
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[sa] = np.repeat(group_end, np.diff(group_end, prepend=-1))
    h = known
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of groups with two members or more
    while len(places):
        suffix = sa[places]
        group = rank[suffix].astype(np.int64)
        ahead = suffix + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        order = _sorted_within(group, second, room)
        suffix, group, second = suffix[order], group[order], second[order]
        sa[places] = suffix
        starts = np.ones(len(places), bool)
        starts[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        last = np.append(starts[1:], True)
        ends = np.flatnonzero(last)
        rank[suffix] = np.repeat(places[ends], np.diff(ends, prepend=-1))
        places = places[~(starts & last)]
        h *= 2
    return sa


def _dense(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct small symbols, and the number of each."""
    held = np.bincount(symbols) > 0
    return np.flatnonzero(held), (np.cumsum(held) - 1)[symbols]


def _sorted_within(group: np.ndarray, second: np.ndarray, room: int) -> np.ndarray:
    """The order by (group, second), where groups lie together already."""
    fresh = np.cumsum(group[1:] != group[:-1])
    number = np.concatenate((np.zeros(1, np.int64), fresh))
    return _sorted_places((number << (room + 1)) | (second + 1), int(number[-1]).bit_length() + room + 1)


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, stride: int = 64) -> np.ndarray:
    """For each place of the suffix array, the common prefix with the place before, up to `limit`.

    Kasai: the prefix at position i is at least that at i - 1, less one. Positions at
    every `stride`-th place are compared from the start, then those half way between
    from the bound their left neighbour gives, and so on; all of a level at once.
    """
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    held = np.zeros(n, np.int64)  # by position
    bits = 8 if int(data.max()) < 256 else 16 if int(data.max()) < 1 << 16 else 32
    lanes = 64 // bits
    padded = np.concatenate([data, np.zeros(lanes, data.dtype)]).astype(np.uint64)
    wide = np.zeros(n + 1, np.uint64)  # the next few symbols of each place in one number, the first lowest
    for j in range(lanes):
        wide |= padded[j:n + 1 + j] << np.uint64(bits * j)
    step, done = stride, 0
    while True:
        at = np.arange(0, n, step) if not done else np.arange(step, n, 2 * step)
        at = at[before[at] >= 0]
        have = np.zeros(len(at), np.int64) if not done else np.maximum(0, held[at - step] - step)
        other = before[at]
        room = np.minimum(limit, n - np.maximum(at, other))
        have = np.minimum(have, room)
        live = np.flatnonzero(have < room)
        while len(live):
            differ = wide[at[live] + have[live]] ^ wide[other[live] + have[live]]
            alike = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // bits  # lanes below the first that differs
            have[live] = np.minimum(have[live] + alike, room[live])
            live = live[(differ == 0) & (have[live] < room[live])]
        held[at] = have
        done += 1
        if step == 1:
            break
        step //= 2
    lcp[1:] = held[sa[1:]]
    return lcp
