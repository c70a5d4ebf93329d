"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy: a helper for one bounded shard.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost-smaller (LMS) substrings are sorted by
one round of induction, named, and the string of names is sorted recursively; a second round induces the whole order from
the sorted LMS suffixes. Induction runs bucket by bucket with whole buckets as vectors. Strings of names outgrow the
buckets after a level or two; from MAX_BUCKETS symbols on, the recursion ends in rank doubling.
"""

from __future__ import annotations

import numpy as np

from .common import ship

MAX_BUCKETS = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the end of the string is smaller than all."""
    step = np.append(s[1:] > s[:-1], False).astype(np.int8) - np.append(s[1:] < s[:-1], True).astype(np.int8)
    turns = np.flatnonzero(step)
    return step[turns[np.searchsorted(turns, np.arange(len(s)))]] > 0


def _scatter(into: list[list], found: np.ndarray, s: np.ndarray) -> None:
    """Appends found to the bucket of each one's symbol, in order."""
    if len(found):
        symbols = s[found]
        order = np.argsort(symbols, kind="stable")
        found, symbols = found[order], symbols[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, part in zip(symbols[np.concatenate([[0], cuts])], np.split(found, cuts), strict=True):
            into[symbol].append(part)


def _bucket(given: list, wanted: np.ndarray, s: np.ndarray, symbol: int, rest: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, list]:
    """One bucket's induced suffixes in order, and what it and `rest` (the bucket's others) induce elsewhere. A suffix induces those
    before it in its run of one symbol (back: how many there are) within the bucket: first each one's nearest, then the next."""
    own = np.concatenate(given) if given else rest[:0]
    times = back[own] + 1
    if len(own) and times.max() > 1:
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        own = (np.repeat(own, times) - step)[np.argsort(step, kind="stable")]
    out = []
    for suffixes in (own, rest):
        before = suffixes[suffixes > 0] - 1
        out.append(before[wanted[before] & (s[before] != symbol)])
    return own, out


def _induce(s: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes, from the LMS suffixes in an order that is right within each symbol."""
    back = np.arange(len(s))
    back -= np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), back, 0))
    given: list[list] = [[] for _ in range(size)]
    starts: list[list] = [[] for _ in range(size)]
    _scatter(starts, lms, s)
    empty = lms[:0]
    firsts = [np.concatenate(x) if x else empty for x in starts]
    given[s[-1]].append(np.array([len(s) - 1], lms.dtype))
    larger: list[np.ndarray] = []
    for symbol in range(size):
        own, out = _bucket(given[symbol], ~smaller, s, symbol, firsts[symbol], back) if given[symbol] or len(firsts[symbol]) else (empty, [])
        larger.append(own)
        if out:
            _scatter(given, np.concatenate(out), s)
    given = [[] for _ in range(size)]
    parts: list[np.ndarray] = []
    for symbol in range(size - 1, -1, -1):
        backwards = larger[symbol][::-1]
        own, out = _bucket(given[symbol], smaller, s, symbol, backwards, back) if given[symbol] or len(backwards) else (empty, [])
        if out:
            _scatter(given, np.concatenate(out), s)
        parts += [own, backwards]
    return np.concatenate(parts)[::-1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the compared length; only suffixes whose rank is shared are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    fresh = np.append(True, names[order][1:] != names[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    length = 1
    while True:
        heads = np.append(np.flatnonzero(fresh), n)
        spread = np.diff(heads)
        many = np.repeat(spread > 1, spread)
        at = np.flatnonzero(many)
        if not len(at):
            return order
        tied = order[at]
        beyond = tied + length
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + second
        again = np.argsort(key, kind="stable")
        tied, key = tied[again], key[again]
        order[at] = tied
        new = np.append(True, key[1:] != key[:-1])
        fresh[at] = new
        rank[tied] = np.maximum.accumulate(np.where(new, at, 0))
        length *= 2


def suffix_array(s: np.ndarray, size: int = 256) -> np.ndarray:
    """Start positions of the suffixes of s (integers below size) in lexicographic order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if size > MAX_BUCKETS:
        return _doubled(s)
    smaller = _smaller(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = _induce(s, size, smaller, lms)
        by_substring = order[is_lms[order]]
        # LMS substrings, up to and with the next LMS position, are named by their rank; equal ones are told by a hash
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        number = np.zeros(n, np.int64)
        number[lms] = np.arange(len(lms))
        ends = np.append(lms[1:] + 1, n)
        length, scale = ends - lms, powers[n - lms]
        value = (sums[ends] - sums[lms]) * scale
        length[-1] = -1  # the last one runs into the end and equals no other
        at = number[by_substring]
        names = np.empty(len(lms), np.int64)
        names[at] = np.cumsum(np.append(False, (value[at][1:] != value[at][:-1]) | (length[at][1:] != length[at][:-1])))
        most = int(names.max()) + 1
        lms = lms[np.argsort(names)] if most == len(lms) else lms[suffix_array(names, most)]
    return _induce(s, size, smaller, lms)


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted: by text position, the common prefix with the preceding suffix of the order, counted up to `most` bytes. The order may be one of
    some of the suffixes; positions that it lacks get 0."""
    n, words = len(s), -(-most // 8)
    laid = np.concatenate([s, np.zeros(8 * words + 8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(laid, 8)).view(np.uint64).ravel()
    before = np.full(n, n)
    before[order[1:]] = order[:-1]
    found = np.zeros(n, np.int64)
    active = np.flatnonzero(before < n)
    for w in range(words):
        unequal = eight[active + 8 * w] ^ eight[before[active] + 8 * w]
        differ = unequal != 0
        low = unequal[differ] & (~unequal[differ] + np.uint64(1))
        found[active[differ]] = 8 * w + np.bitwise_count(low - np.uint64(1)) // 8
        found[active[~differ]] = 8 * w + 8
        active = active[~differ]
    return np.minimum(np.minimum(found, most), n - np.maximum(np.arange(n), np.minimum(before, n)))


ship(__name__)
