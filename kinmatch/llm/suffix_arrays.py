"""Suffix arrays by induced sorting, for the strings of one task."""

from __future__ import annotations

import numpy as np

from .hashing import prefix_sums, range_hash


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (S); equal symbols take the type of the next different one."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = -1  # the last suffix is larger than the empty one after it
    at = np.where(rises != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return rises[following] > 0


def _deal(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many equal symbols come before each one, and the number of each symbol."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=size)
    nth = np.empty(len(symbols), np.int64)
    nth[order] = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    return nth, counts


def _induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost smaller ones in an order that is right for their purpose.

    Works bucket by bucket: what a bucket holds is put in front of other buckets' free places
    all at once; only runs of one symbol need further turns in their own bucket.
    """
    n, size = len(text), len(first)
    order = np.full(n, -1)
    symbols = text[leftmost]
    nth, given = _deal(symbols, size)
    order[last[symbols] - given[symbols] + nth] = leftmost
    seeds = [order[last[c] - given[c] : last[c]].copy() if given[c] else () for c in range(size)]

    def send(found: np.ndarray, free: np.ndarray, kind: bool) -> None:
        """Put the suffixes one place before `found`, if of this kind, to the free ends of their buckets."""
        j = found - 1
        j = j[j >= 0]
        j = j[small[j] == kind]
        if len(j):
            c = text[j]
            nth, counts = _deal(c, size)
            order[free[c] - 1 - nth if kind else free[c] + nth] = j
            free += -counts if kind else counts

    used = np.flatnonzero(last > first)
    head = first.copy()
    # The suffix before the (empty) end of the text comes first of its bucket.
    order[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for c in used:
        at = first[c]
        while at < head[c]:
            now, at = order[at : head[c]].copy(), head[c]
            send(now, head, False)
        if len(seeds[c]):
            send(seeds[c], head, False)
    tail = last.copy()
    for c in used[::-1]:
        at = last[c]
        while at > tail[c]:
            now, at = order[tail[c] : at][::-1].copy(), tail[c]
            send(now, tail, True)
        if head[c] > first[c]:
            send(order[first[c] : head[c]][::-1].copy(), tail, True)
    return order


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffixes of a text of many names in order: ranks of ever longer prefixes until all differ."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        _, new = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank, step = new, step * 2
        if rank.max() == n - 1:
            return np.argsort(rank)
        if step >= n:
            raise AssertionError("suffixes of one text differ")


#: Reduced texts of more names are ordered by doubling: their buckets hold next to nothing.
MOST_NAMES = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` (small non-negative numbers) in order; the end counts as smaller than any symbol."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = int(text.max()) + 1
    last = np.cumsum(np.bincount(text, minlength=size))
    first = np.concatenate(([0], last[:-1]))
    if len(leftmost) > 1:
        order = _induce(text, small, leftmost, first, last)
        # Substrings from one leftmost smaller suffix to the next are in order now; equal ones get equal names.
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        sorted_ = order[is_leftmost[order]]
        stop = np.full(n, n)
        stop[leftmost[:-1]] = leftmost[1:] + 1
        keys = range_hash(prefix_sums(text), sorted_, stop[sorted_])
        lengths = stop[sorted_] - sorted_
        last_one = sorted_ == leftmost[-1]  # it runs into the end, which no other does
        new = np.ones(len(sorted_), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (lengths[1:] != lengths[:-1]) | last_one[1:] | last_one[:-1]
        names = np.zeros(n, np.int64)
        names[sorted_] = np.cumsum(new) - 1
        reduced = names[leftmost]
        if new.all():
            leftmost = sorted_
        else:
            leftmost = leftmost[suffix_array(reduced) if names.max() < MOST_NAMES else _by_doubling(reduced)]
    return _induce(text, small, leftmost, first, last)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int = 127, least: int = 0) -> np.ndarray:
    """For each place of the text, how far its suffix agrees with the one before it in order, `most` at most.

    Less than `least` counts as 0. Prefixes are compared by their hashes, by halving lengths.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    other, sums = before[at], prefix_sums(text)
    if least:  # one look at most places
        fits = np.flatnonzero(np.maximum(at, other) + least <= n)
        a, b = at[fits], other[fits]
        fits = fits[range_hash(sums, a, a + least) == range_hash(sums, b, b + least)]
        at, other = at[fits], other[fits]
    agreed, step = np.full(len(at), least), 1 << (most - least).bit_length() >> 1
    while step:
        fits = (np.maximum(at, other) + agreed + step <= n) & (agreed + step <= most)
        a, b = at[fits] + agreed[fits], other[fits] + agreed[fits]
        agreed[np.flatnonzero(fits)[range_hash(sums, a, a + step) == range_hash(sums, b, b + step)]] += step
        step //= 2
    out = np.zeros(n, np.int64)
    out[at] = agreed
    return out


def repeats_earlier(text: np.ndarray, length: int) -> np.ndarray:
    """For each place, whether the `length` (127 at most) symbols from there also start at an earlier place."""
    order = suffix_array(text)
    alike = permuted_common_prefixes(text, order, least=length)[order] >= length
    out = np.zeros(len(text), bool)
    if len(text):
        begins = np.flatnonzero(~alike)
        earliest = np.minimum.reduceat(order, begins)
        out[order] = order != np.repeat(earliest, np.diff(np.append(begins, len(order))))
    return out
