"""Runs of like keys: what a whole run can score at most, and the best pairs of chosen runs.

Right keys in an order that brings like ones together are cut into runs.  A run is told by the least and the most
that its keys have of each character, by their lengths and by the tokens any of them has.  This bounds the token-set
score of a left key with every key of the run, so that a run below the left key's bar need not be looked at.
"""

from __future__ import annotations

import numpy as np

from .kernel import BUDGET, Block, _Bounds, _keep_best, _promising, encode

CHARS = 64  # characters that agree in the lower six bits share a count; those from blank to underscore don't
BUCKETS = 2048  # tokens are told apart by that many hashes
LONGEST = 250  # left keys from this length on are bounded by no run
GROUP = 32  # runs bounded together at first
TOGETHER = 16  # left keys that share a look at the union of their runs


def _bucket(word: str) -> int:
    """Hash of a token, the same in every process."""
    h = 0
    for c in word.encode("utf-8", "surrogatepass"):
        h = (h * 31 + c) & 0xFFFFFFFF
    return ((h * 2654435761) & 0xFFFFFFFF) >> 21


class Hashes(dict):
    """Buckets of tokens, remembered; forgotten when there are very many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = _bucket(word)
        return found


def _counts(block: Block) -> np.ndarray:
    """Characters of every key, blanks in front included."""
    owner, _, spot = block.spots(np.arange(block.n))
    return np.bincount(owner * CHARS + (block.char[spot] & (CHARS - 1)), minlength=block.n * CHARS).reshape(block.n, CHARS)


def summarize(keys: list[str], run: np.ndarray) -> dict[str, np.ndarray]:
    """The summaries of the runs of some keys; ``run`` ascends."""
    block, hashes = Block(keys, True), Hashes()
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    counts = _counts(block)
    bits = np.zeros((len(first), BUCKETS), bool)
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    bits[place[block.place[1]], [hashes[w] for w in block.words]] = True
    return {
        "run": run[first],
        # A left key that is bounded has no more than 255 of a character.
        "least": np.minimum(np.minimum.reduceat(counts, first), 255).astype(np.uint8),
        "most": np.minimum(np.maximum.reduceat(counts, first), 255).astype(np.uint8),
        "shortest": np.minimum.reduceat(block.total, first).astype(np.int32),
        "longest": np.maximum.reduceat(block.total, first).astype(np.int32),
        "tokens": np.packbits(bits, axis=1),
    }


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One set of summaries in the order of the runs."""
    whole = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    order = np.argsort(whole["run"], kind="stable")
    return {name: x[order] for name, x in whole.items()}


def _grouped(x: np.ndarray) -> np.ndarray:
    """Values of runs (the last axis) by group, filled up with zeros."""
    missing = -x.shape[-1] % GROUP
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, missing)])
    return np.ascontiguousarray(padded.reshape(*x.shape[:-1], -1, GROUP))


class _Level:
    """Summaries by character and by token: of groups of runs, or of the runs of each group."""

    def __init__(self, least, most, shortest, longest, tokens, runs: bool):
        form = _grouped if runs else np.ascontiguousarray
        self.least, self.most, self.tokens = form(least.T), form(most.T), form(tokens.T)
        self.shortest, self.longest = form(shortest.astype(np.float32)), form(longest.astype(np.float32))
        self.fixed = form(least.sum(axis=1, dtype=np.int64).astype(np.float32))

    def bounds(self, key, some: np.ndarray | None = None, guess: bool = False) -> np.ndarray:
        """The most that any key of the groups ``some`` can score, or, to order them, a guess that grows with what they score."""
        chars, counts, buckets, sizes, total = key
        some = slice(None) if some is None else some

        def pick(x, rows):
            return x[rows] if isinstance(some, slice) else x[np.ix_(rows, some)]

        across = (-1,) + (1,) * (self.least.ndim - 1)
        counts, sizes = counts.reshape(across), sizes.reshape(across)
        sure, able = (np.minimum(pick(x, chars), counts).sum(axis=0, dtype=np.uint8).astype(np.float32) for x in (self.least, self.most))
        has = pick(self.tokens, buckets >> 3) >> (7 - (buckets & 7)).astype(np.uint8).reshape(across)
        shared = ((has & 1) * sizes).sum(axis=0, dtype=np.uint8).astype(np.float32)
        shortest, longest, fixed = self.shortest[some], self.longest[some], self.fixed[some]
        # A key has the characters all have, and some more: each may match, and each makes it longer.
        length = np.clip(able - sure + fixed, shortest, longest)
        overlap = np.minimum(able, sure + (length - fixed))
        bound = (overlap - 1) / np.maximum(total + length - 2, 1)
        contained = (shared - 1) / np.maximum(np.minimum(total, shortest) + shared - 2, 1)
        bound = np.clip(np.maximum(bound, contained) * 200, 0, 100)
        return (bound + (sure + shared) * (100 / total) if guess else bound).ravel()


class Index:
    """All runs of one kind, bounded by groups first."""

    def __init__(self, whole: dict[str, np.ndarray]):
        self.run = whole["run"]
        self.runs = _Level(*(whole[x] for x in ("least", "most", "shortest", "longest", "tokens")), runs=True)
        first = np.arange(0, len(self.run), GROUP)
        self.groups = _Level(
            np.minimum.reduceat(whole["least"], first),
            np.maximum.reduceat(whole["most"], first),
            np.minimum.reduceat(whole["shortest"], first),
            np.maximum.reduceat(whole["longest"], first),
            np.bitwise_or.reduceat(whole["tokens"], first),
            runs=False,
        )
        self.hashes = Hashes()

    def _told(self, key: str):
        words = key.split(" ")
        code = np.frombuffer((" " + key).encode("utf-32-le", "surrogatepass"), np.uint32) & (CHARS - 1)
        counts = np.bincount(code, minlength=CHARS)
        chars = np.flatnonzero(counts)
        buckets = np.array([self.hashes[w] for w in words])
        return chars, counts[chars].astype(np.uint8), buckets, np.array([len(w) + 1 for w in words], np.uint8), len(key) + 1

    def _in(self, groups: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Places of the chosen ones among the runs of some groups."""
        some = groups[chosen // GROUP] * GROUP + chosen % GROUP
        return some[some < len(self.run)]

    def reaching(self, key: str, bar: float) -> np.ndarray:
        """Places of the runs with a key that may score ``bar``."""
        if not key:
            return np.arange(len(self.run) if bar <= 0 else 0)
        if len(key) >= LONGEST:
            return np.arange(len(self.run))
        told = self._told(key)
        groups = np.flatnonzero(self.groups.bounds(told) >= bar)
        return self._in(groups, np.flatnonzero(self.runs.bounds(told, groups) >= bar))

    def nearest(self, key: str, n: int) -> np.ndarray:
        """Places of up to ``n`` runs that may score high."""
        if not key or len(key) >= LONGEST or len(self.run) <= n:
            return np.arange(min(n, len(self.run)))
        told = self._told(key)
        best = self.groups.bounds(told, guess=True)
        groups = np.sort(np.argpartition(-best, min(n, len(best)) - 1)[:n])
        best = self.runs.bounds(told, groups, guess=True)
        return np.sort(self._in(groups, np.argpartition(-best, min(n, len(best)) - 1)[:n]))


class _Columns:
    """Some strings of a block; what it shares with the block is not copied."""

    def __init__(self, block: Block, cols: np.ndarray):
        self.n, self.width, self.char, self.char_slot = len(cols), block.width, block.char, block.char_slot
        self.size, self.start, self.token = block.size[:, cols], block.start[:, cols], block.token[:, cols]
        self.total = block.total[cols]


class _SomeBounds(_Bounds):
    """Bounds of a block's left strings with some of its right strings."""

    def __init__(self, whole: _Bounds, starts: np.ndarray, cols: np.ndarray):
        self.a, self.b, self.kind, self.whole, self.starts, self.cols = whole.a, _Columns(whole.b, cols), whole.kind, whole, starts, cols
        self.a_count, self.b_count = whole.a_count, whole.b_count[:, cols]
        self.rows, self.least = {}, {}

    def _has(self, token: int, size: int):
        """``size`` for the strings that have a token, 0 for the others; made once, as like strings share tokens."""
        if token not in self.rows:
            low, high = self.starts[token : token + 2]
            if low == high:
                self.rows[token] = None
            else:
                here = np.zeros(self.whole.b.n, self.kind)
                here[self.whole.posting_row[low:high]] = size
                self.rows[token] = here[self.cols]
        return self.rows[token]

    def _shared(self, rows: slice) -> np.ndarray:
        token, size = self.a.token[:, rows].T, self.a.size[:, rows].T
        shared = np.zeros((len(token), self.b.n), self.kind)
        for i, slot in zip(*np.nonzero(size > 0)):
            here = self._has(int(token[i, slot]), int(size[i, slot]))
            if here is not None:
                shared[i] += here
        return shared

    def _overlap(self, rows: slice) -> np.ndarray:
        counts = self.a_count[rows]
        overlap = np.zeros((len(counts), self.b.n), self.kind)
        for i, c in zip(*np.nonzero(counts)):
            level = (c, counts[i, c])
            if level not in self.least:
                self.least[level] = np.minimum(self.b_count[c], counts[i, c])
            overlap[i] += self.least[level]
        return overlap


def best_in_runs(left: list[str], right: list[str], cutoff: np.ndarray, order: np.ndarray, run: np.ndarray, wanted: list[np.ndarray], k: int):
    """Per left string the ``k`` best right strings of its runs, and maybe of more runs.

    ``run`` tells the ascending run of each right string, ``wanted`` the runs of each left string.  Otherwise like
    :func:`kernel.best_pairs`: only scores of at least ``cutoff`` count, ties go to the lower ``order``, and the result
    is (left index, right index, score).
    """
    # Strings with lists of runs that are alike, and about as long, are looked at together.
    by_runs = sorted(range(len(left)), key=lambda i: (len(wanted[i]).bit_length(), np.asarray(wanted[i], ">i8").tobytes()))
    left, cutoff, wanted = [left[i] for i in by_runs], cutoff[by_runs], [wanted[i] for i in by_runs]
    a, b, alphabet = encode(left, right, tokens=True)
    whole = _Bounds(a, b, alphabet, capped=False)
    # Where the strings of each token begin among the postings.
    starts = np.searchsorted(whole.posting_token, np.arange(max(a.token.max(initial=0), b.token.max(initial=0)) + 2, dtype=np.int32))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    first = 0
    while first < a.n:
        last = min(first + TOGETHER, a.n)
        while True:
            runs = np.unique(np.concatenate(wanted[first:last]))
            begin, end = np.searchsorted(run, runs, "left"), np.searchsorted(run, runs, "right")
            if last == first + 1 or (end - begin).sum() * (last - first) <= BUDGET:
                break
            last = first + max(1, (last - first) // 2)
        size = end - begin
        cols = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        if len(cols):
            rows = slice(first, last)
            some = _SomeBounds(whole, starts, cols)
            row, col, score = _promising(a, some.b, alphabet, some, rows, cutoff[rows], np.full((last - first, k), -1.0), k)
            found.append(_keep_best(row, cols[col], score, cutoff, order, k))
        first = last
    row, col, score = (np.concatenate(x) for x in zip(*found))
    return np.asarray(by_runs, np.int64)[row], col, score
