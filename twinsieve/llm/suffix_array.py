"""Suffix arrays of byte texts by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbours. The leftmost S suffixes
are sorted: their substrings by inducing, then, where substrings repeat, their suffixes on the string of
substring names. From them all L and then all S suffixes are induced, bucket by bucket in whole arrays:
what a bucket's suffixes induce into other buckets is moved at once, what they induce into their own
comes in waves, as many as the longest run of its symbol.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is a unique smallest one."""
    n = len(s)
    small = np.empty(n, bool)
    small[-1] = True
    change = np.flatnonzero(s[1:] != s[:-1])
    rises = s[change] < s[change + 1]
    small[:-1] = np.repeat(rises, np.diff(np.concatenate(([-1], change))))
    return small


def _scatter(positions: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their symbols, keeping their order."""
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    begin = 0
    for end in [*cuts.tolist(), len(symbols)]:
        into[symbols[begin]].append(positions[begin:end])
        begin = end


def _wave(entries: np.ndarray, symbol: int, wanted: np.ndarray, into: list[list[np.ndarray]]) -> np.ndarray:
    """Induce from ``entries``: others' suffixes go to their buckets, those of ``symbol`` are returned.

    ``wanted`` has the symbols of the suffixes to induce and 0 elsewhere, at the last position too, where the first one's neighbour wraps to.
    """
    before = entries - 1
    symbols = wanted[before]
    some = symbols != 0
    before, symbols = before[some], symbols[some]
    if not len(before):
        return before
    own = symbols == symbol
    if own.any():
        _scatter_rest = ~own
        if _scatter_rest.any():
            _scatter(before[_scatter_rest], symbols[_scatter_rest], into)
        return before[own]
    _scatter(before, symbols, into)
    return before[:0]


def _induce(s: np.ndarray, small: np.ndarray, width: int, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in ``seeds`` (in order within each symbol)."""
    large = np.where(small, s.dtype.type(0), s)
    empty = np.empty(0, seeds.dtype)
    seeded: list[list[np.ndarray]] = [[] for _ in range(width)]
    _scatter(seeds, s[seeds], seeded)
    arriving: list[list[np.ndarray]] = [[] for _ in range(width)]
    left: list[np.ndarray] = [empty] * width
    for c in range(width):
        wave = np.concatenate(arriving[c]) if arriving[c] else empty
        waves = []
        while len(wave):
            waves.append(wave)
            wave = _wave(wave, c, large, arriving)
        left[c] = np.concatenate(waves) if waves else empty
        if seeded[c]:
            _wave(np.concatenate(seeded[c]), c, large, arriving)
    arriving = [[] for _ in range(width)]
    right: list[np.ndarray] = [empty] * width
    rising = s - large
    for c in range(width - 1, -1, -1):
        wave = np.concatenate(arriving[c]) if arriving[c] else empty
        waves = []
        while len(wave):
            waves.append(wave)
            wave = _wave(wave, c, rising, arriving)
        # L suffixes come before S suffixes of a bucket, so the scan from the right meets them last;
        # what they induce into their own bucket cannot be of type S.
        if len(left[c]):
            _wave(left[c][::-1], c, rising, arriving)
        right[c] = np.concatenate(waves)[::-1] if waves else empty
    right[0] = np.array([len(s) - 1], seeds.dtype)  # the last symbol
    return np.concatenate([x for c in range(width) for x in (left[c], right[c])])


def _names(s: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For substrings in order, the index of the first one that equals each."""
    words = symbol_words(s)
    each = 8 // s.itemsize  # symbols of a word
    same = length[1:] == length[:-1]
    live, done = np.flatnonzero(same), 0
    while len(live):
        rest = np.minimum(length[live] - done, each).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8 * s.itemsize))
        equal = (words[order[live] + done] ^ words[order[live + 1] + done]) & mask == 0
        same[live[~equal]] = False
        done += each
        live = live[equal]
        live = live[length[live] > done]
    fresh = np.concatenate(([True], ~same))
    return np.flatnonzero(fresh)[np.cumsum(fresh) - 1]


def _refined(order: np.ndarray, first: np.ndarray, starts: np.ndarray, need: np.ndarray) -> np.ndarray:
    """``order`` of substrings, by the index of the first equal one, to that of the suffixes which begin with them.

    Substring i reaches from starts[i] to starts[i + 1], with that symbol. Groups of equal ones are sorted by what follows, twice as
    many substrings each time, until they agree on ``need`` symbols from their starts.
    """
    m = len(order)
    rank = np.empty(m, np.int64)
    rank[order] = first
    alone = np.bincount(first, minlength=m) == 1
    live = np.flatnonzero(~alone[first])  # places in order
    step = 1
    while len(live):
        own = order[live]
        after = np.minimum(own + step, m - 1)  # the last substring is one of its own
        more = starts[after] + 1 - starts[own] < need[own]
        live, own, after = live[more], own[more], after[more]
        if not len(live):
            break
        # A group's substrings agree, so they stay or leave together, and its places lie next to each other.
        keys = rank[own] * m + rank[after]
        turn = np.argsort(keys)
        own, keys = own[turn], keys[turn]
        order[live] = own
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        begin = np.flatnonzero(fresh)
        rank[own] = np.repeat(live[begin], np.diff(np.append(begin, len(live))))
        tied = ~fresh
        tied[:-1] |= tied[1:]
        live = live[tied]
        step *= 2
    return order


def suffix_array(s: np.ndarray, width: int, depth: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least, or those up to the next of ``ends``.

    ``s`` holds small integers under ``width``; its last symbol is the only 0. ``ends``, if given, are the places of
    a symbol under all others but that.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    if not len(leftmost):
        leftmost = np.array([n - 1], leftmost.dtype)
    if len(leftmost) == 1:
        return _induce(s, small, width, leftmost)
    number = np.full(n, -1, leftmost.dtype)
    number[leftmost] = np.arange(len(leftmost), dtype=leftmost.dtype)
    order = number[_induce(s, small, width, leftmost)]
    order = order[order >= 0]
    # Name the substrings between leftmost S suffixes: equal ones share a name.
    length = np.minimum(np.append(np.diff(leftmost) + 1, 1), depth)
    first = _names(s, leftmost[order], length[order])
    if (np.diff(first) == 0).any():
        need = np.full(len(leftmost), depth, np.int64)
        if ends is not None:
            stops = np.append(ends, n - 1)
            need = np.minimum(need, stops[np.searchsorted(stops, leftmost)] - leftmost)
        order = _refined(order, first, leftmost, need)
    return _induce(s, small, width, leftmost[order])


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as unsigned integers; the end is padded with zeros."""
    n = len(raw)
    padded = np.zeros((n + 15) // 8 * 8 + 8, np.uint8)
    padded[:n] = raw
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = np.frombuffer(padded, "<u8", count, o)
    return out


def symbol_words(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each symbol."""
    return words_at(s.view(np.uint8))[::s.itemsize]


def permuted_common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position of ``raw``, the symbols (``most`` at the utmost) that it shares with the suffix before it in ``order``.

    ``order`` may leave suffixes out; every suffix in it has ``most`` symbols at least.
    """
    out = np.zeros(len(raw), np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(raw), -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    there = before[here]
    words = symbol_words(raw)
    each = 8 // raw.itemsize
    for step in range(0, most, each):
        gap = words[here + step] ^ words[there + step]
        equal = gap == 0
        low = gap[~equal]
        out[here[~equal]] = np.minimum(step + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // (8 * raw.itemsize), most)
        here, there = here[equal], there[equal]
        out[here] = min(step + each, most)
        if not len(here):
            break
    return out
