"""Vectorised string comparison for use inside Arrow tasks.

Spark partitions the work and hands a task two bounded blocks of strings; the
functions here compare many pairs of them at once.  The longest common
subsequence is the bit-parallel recurrence of Hyyrö (2004), run over all pairs
side by side: every pair holds its state in 64-bit words and one step consumes
one character of the right-hand string.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa

WORD = 64
# Elements held in one temporary array; keeps the working set near the CPU caches.
BUDGET = 1 << 18
# Strings of one side that are encoded and bounded together.
PART = 1 << 14


class Block:
    """Strings encoded for comparison.

    Each token is stored with one blank in front.  With ``tokens=False`` the
    whole string counts as a single token, which gives plain string comparison.
    """

    def __init__(self, texts: list[str], tokens: bool):
        if tokens:
            self.words = " ".join(filter(None, texts)).split(" ") if any(texts) else []
            counts = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, len(texts))
        else:
            self.words = texts
            counts = np.ones(len(texts), np.int64)
        sizes = np.fromiter(map(len, self.words), np.int32, len(self.words)) + np.int32(1)
        row = np.repeat(np.arange(len(texts)), counts)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.n = len(texts)
        self.width = max(int(counts.max(initial=0)), 1)
        # One row per token slot, one column per string.
        self.place = (slot, row)
        self.size = np.zeros((self.width, self.n), np.int32)
        self.size[self.place] = sizes
        self.total = self.size.sum(axis=0, dtype=np.int64)  # characters, blanks in front included
        self.offset = np.cumsum(self.total) - self.total
        self.start = self.offset + np.cumsum(self.size, axis=0) - self.size
        text = " " + " ".join(self.words) if self.words else ""
        self.char = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        self.char_slot = np.repeat(slot, sizes).astype(np.int32)
        self.token = np.full((self.width, self.n), -1, np.int32)

    def name_tokens(self, ids, padding: int) -> None:
        self.token[:] = padding
        self.token[self.place] = ids

    def spots(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the characters of ``rows``: index into rows, place in the string, index into ``char``."""
        total = self.total[rows]
        owner = np.repeat(np.arange(len(rows)), total)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
        return owner, place, place + np.repeat(self.offset[rows], total)


def encode(left: list[str], right: list[str], tokens: bool) -> tuple[Block, Block, int]:
    """Encode both sides over one shared vocabulary and a dense alphabet."""
    a, b = Block(left, tokens), Block(right, tokens)
    if tokens:
        ids = pa.array(a.words + b.words, pa.large_string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        # Padding never equals a token or the other side's padding.
        a.name_tokens(ids[: len(a.words)], -1)
        b.name_tokens(ids[len(a.words) :], -2)
    else:
        a.name_tokens(0, -1)
        b.name_tokens(1, -2)
    seen = np.zeros(max(a.char.max(initial=0), b.char.max(initial=0)) + 1, bool)
    seen[a.char] = True
    seen[b.char] = True
    dense = np.cumsum(seen) - 1
    dense = dense.astype(np.int32)
    a.char, b.char = dense[a.char], dense[b.char]
    return a, b, int(seen.sum())


class _Masks:
    """Bit masks of some left strings: one row of words per 64 characters."""

    def __init__(self, block: Block, rows: np.ndarray, alphabet: int):
        self.words = int(-(-block.total[rows].max() // WORD))
        self.alphabet = alphabet
        owner, place, spot = block.spots(rows)
        bit = np.uint64(1) << (place % WORD).astype(np.uint64)
        by_char = np.zeros(self.words * len(rows) * alphabet, np.uint64)
        np.add.at(by_char, ((place // WORD) * len(rows) + owner) * alphabet + block.char[spot], bit)
        by_slot = np.zeros(self.words * block.width * len(rows), np.uint64)
        np.add.at(by_slot, ((place // WORD) * block.width + block.char_slot[spot]) * len(rows) + owner, bit)
        self.by_char = by_char.reshape(self.words, -1)
        self.by_slot = by_slot.reshape(self.words, block.width, len(rows))


def _fold(masks: _Masks, row, keep, codes, start, length) -> np.ndarray:
    """LCS per pair of the kept left bits and ``codes[start:start+length]``."""
    order = np.argsort(-length, kind="stable")
    start, base = start[order], (row[order] * masks.alphabet).astype(np.int32)
    keep = keep[:, order]
    state = np.full(keep.shape, np.iinfo(np.uint64).max, np.uint64)
    # still[j] = how many pairs have a character at position j
    still = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    for j, n in enumerate(still):
        at = base[:n] + codes[start[:n] + j]
        carry = None
        for w in range(masks.words):
            held = state[w, :n]
            hit = masks.by_char[w].take(at)
            hit &= keep[w, :n]
            hit &= held
            added = held + hit
            if masks.words > 1:
                over = added < held
                if carry is not None:
                    bumped = added + carry
                    over |= bumped < added
                    added = bumped
                carry = over.astype(np.uint64)
            hit ^= held
            np.bitwise_or(added, hit, out=held)
    found = np.bitwise_count(~state).sum(axis=0, dtype=np.int64)
    result = np.empty_like(found)
    result[order] = found
    return result


def _batches(block: Block, row: np.ndarray, cost: np.ndarray, alphabet: int):
    """Split pairs (sorted by left row) so masks and temporaries stay bounded."""
    per_row = (alphabet + block.width) * np.maximum(-(-block.total // WORD), 1)
    weight = np.cumsum(cost)
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    table = np.cumsum(np.where(new_row, per_row[row], 0))
    begin = 0
    while begin < len(row):
        spent = weight[begin - 1] if begin else 0
        built = table[begin] - per_row[row[begin]]
        end = min(np.searchsorted(weight, spent + 4 * BUDGET), np.searchsorted(table, built + 4 * BUDGET))
        end = max(int(end), begin + 1)
        yield slice(begin, end)
        begin = end


def compare(a: Block, b: Block, alphabet: int, row: np.ndarray, col: np.ndarray, tokens: bool) -> np.ndarray:
    """Score the pairs ``(a[row], b[col])`` from 0 to 100.

    ``tokens=True`` gives the token-set ratio, ``False`` the plain ratio.
    """
    result = np.zeros(len(row))
    if not len(row):
        return result
    # Left strings of like size share a batch, so a few long ones do not widen the rest.
    words = -(-a.total // WORD)
    order = np.lexsort((row, words[row]))
    cost = (a.width * b.width if tokens else 1) // 8 + b.total[col] + a.width * words[row]
    for part in _batches(a, row[order], cost[order], alphabet):
        pick = order[part]
        result[pick] = _compare_batch(a, b, alphabet, row[pick], col[pick], tokens)
    return result


def _common(a: Block, b: Block, row, col):
    """Which token slots of the left and right string of each pair occur on the other side."""
    left, right = a.token[:, row], b.token[:, col]
    in_a, in_b = np.zeros(left.shape, bool), np.zeros(right.shape, bool)
    if a.width * b.width > 4096:  # few long strings
        same = left[:, None, :] == right[None, :, :]
        return same.any(axis=1), same.any(axis=0)
    for i in range(a.width):
        for j in range(b.width):
            same = left[i] == right[j]
            in_a[i] |= same
            in_b[j] |= same
    return in_a, in_b


def _compare_batch(a, b, alphabet, row, col, tokens):
    if tokens:
        in_a, in_b = _common(a, b, row, col)
    else:
        in_a, in_b = np.zeros((1, len(row)), bool), np.zeros((1, len(row)), bool)
    shared = (a.size[:, row] * in_a).sum(axis=0, dtype=np.int64)
    rest_a, rest_b = a.total[row] - shared, b.total[col] - shared
    lcs = np.zeros(len(row), np.int64)
    open_ = np.flatnonzero((rest_a > 0) & (rest_b > 0))
    if len(open_):
        # Both remainders start with a blank, which adds exactly one to the LCS.
        lcs[open_] = _remainder_lcs(a, b, alphabet, row[open_], col[open_], in_a[:, open_], in_b[:, open_]) - 1
    len_a, len_b = a.total[row] - 1, b.total[col] - 1
    gap = np.maximum(rest_a - 1, 0) + np.maximum(rest_b - 1, 0) - 2 * lcs
    with np.errstate(divide="ignore", invalid="ignore"):
        if not tokens:
            return np.where(len_a + len_b == 0, 100.0, 100.0 - 100.0 * gap / (len_a + len_b))
        score = 100.0 - 100.0 * gap / (len_a + len_b)
        common = shared - 1
        by_a = 100.0 - 100.0 * rest_a / (common + len_a)
        by_b = 100.0 - 100.0 * rest_b / (common + len_b)
        score = np.where(shared > 0, np.maximum(score, np.maximum(by_a, by_b)), score)
        score = np.where((shared > 0) & ((rest_a == 0) | (rest_b == 0)), 100.0, score)
    return np.where((a.total[row] == 0) | (b.total[col] == 0), 0.0, score)


def _remainder_lcs(a, b, alphabet, row, col, in_a, in_b):
    rows, local = np.unique(row, return_inverse=True)
    masks = _Masks(a, rows, alphabet)
    keep = np.zeros((masks.words, len(row)), np.uint64)
    for w in range(masks.words):
        for i in range(a.width):
            bits = masks.by_slot[w, i].take(local)
            bits[in_a[i]] = 0
            keep[w] |= bits
    # Write the kept tokens of every right-hand string one after another.
    pair, slot = np.nonzero(~in_b.T & (b.token[:, col].T >= 0))
    size, start = b.size[slot, col[pair]], b.start[slot, col[pair]]
    end = np.cumsum(size, dtype=np.int64)
    spot = np.repeat((start - (end - size)).astype(np.int32), size)
    spot += np.arange(len(spot), dtype=np.int32)
    length = np.bincount(pair, weights=size, minlength=len(col)).astype(np.int64)
    return _fold(masks, local, keep, b.char.take(spot), np.cumsum(length) - length, length)


def _parts(texts: list[str]):
    """Split strings into runs of like size, so that a few long ones do not widen all tables."""
    counts = np.fromiter((max(t.count(" ") + 1, len(t) // 16) for t in texts), np.int64, len(texts))
    order = np.argsort(counts, kind="stable")
    begin = 0
    while begin < len(order):
        end = min(begin + PART, len(order))
        while end > begin + 1 and counts[order[end - 1]] * (end - begin) > 16 * PART:
            end = begin + max(1, (end - begin) // 2)
        yield order[begin:end]
        begin = end


def pair_scores(left: list[str], right: list[str], tokens: bool) -> np.ndarray:
    """Scores of a list of pairs."""
    if not tokens:
        return _pair_scores(left, right, tokens)
    result = np.zeros(len(left))
    for part in _parts([max(x, y, key=lambda t: t.count(" ")) for x, y in zip(left, right)]):
        result[part] = _pair_scores([left[i] for i in part], [right[i] for i in part], tokens)
    return result


def _pair_scores(left: list[str], right: list[str], tokens: bool) -> np.ndarray:
    """The same for one part; equal strings are encoded once."""
    a_index = {t: i for i, t in enumerate(dict.fromkeys(left))}
    b_index = {t: i for i, t in enumerate(dict.fromkeys(right))}
    a, b, alphabet = encode(list(a_index), list(b_index), tokens)
    row = np.fromiter((a_index[t] for t in left), np.int64, len(left))
    col = np.fromiter((b_index[t] for t in right), np.int64, len(right))
    return compare(a, b, alphabet, row, col, tokens)


def partial_scores(left: list[str], right: list[str]) -> np.ndarray:
    """Best plain ratio of the shorter string against any window of the longer one.

    Windows are as long as the shorter string, or cut off by either end of the
    longer one.  Strings of equal length are tried both ways round.
    """
    swap = [len(x) > len(y) for x, y in zip(left, right)]
    short = [y if s else x for x, y, s in zip(left, right, swap)]
    long_ = [x if s else y for x, y, s in zip(left, right, swap)]
    result = _window_scores(short, long_)
    equal = np.flatnonzero([len(x) == len(y) for x, y in zip(left, right)])
    if len(equal):
        turned = _window_scores([long_[i] for i in equal], [short[i] for i in equal])
        result[equal] = np.maximum(result[equal], turned)
    return result


def _window_scores(short: list[str], long_: list[str]) -> np.ndarray:
    a_index = {t: i for i, t in enumerate(dict.fromkeys(short))}
    b_index = {t: i for i, t in enumerate(dict.fromkeys(long_))}
    a, b, alphabet = encode(list(a_index), list(b_index), tokens=False)
    row = np.fromiter((a_index[t] for t in short), np.int64, len(short))
    col = np.fromiter((b_index[t] for t in long_), np.int64, len(long_))
    len_a, len_b = a.total[row] - 1, b.total[col] - 1
    result = np.where(len_b == 0, 100.0, 0.0)  # an empty string is like an empty one only
    some = np.flatnonzero(len_a > 0)
    order = some[np.lexsort((row[some], -(-a.total[row[some]] // WORD)))]
    windows = len_a + len_b - 1
    cost = windows[order] * (len_a[order] // 8 + 8)
    for part in _batches(a, row[order], cost, alphabet) if len(order) else ():
        pick = order[part]
        rows, local = np.unique(row[pick], return_inverse=True)
        masks = _Masks(a, rows, alphabet)
        pair = np.repeat(np.arange(len(pick)), windows[pick])
        first = np.cumsum(windows[pick]) - windows[pick]
        shift = np.arange(len(pair)) - first[pair] - (len_a[pick] - 1)[pair]
        begin = np.maximum(shift, 0)
        length = np.minimum(shift + len_a[pick][pair], len_b[pick][pair]) - begin
        keep = masks.by_slot[:, 0, :][:, local[pair]].copy()
        keep[0] &= ~np.uint64(1)  # without the blank in front
        lcs = _fold(masks, local[pair], keep, b.char, (b.offset[col[pick]] + 1)[pair] + begin, length)
        both = len_a[pick][pair] + length
        score = 100.0 - 100.0 * (both - 2 * lcs) / both
        result[pick] = np.maximum.reduceat(score, first)
    return result


def _sorted_words(t: str) -> str:
    return " ".join(sorted(t.split()))


def _word_key(t: str) -> str:
    return " ".join(sorted(set(t.split())))


def weighted_scores(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted maximum of the other scores, chosen by how much the lengths differ.

    Below a length ratio of 1.5 whole strings and tokens are compared; from
    there on windows count as well, and less beyond a ratio of 8.
    """
    len_a, len_b = (np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right))
    shorter, longer = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    result = np.zeros(len(left))
    alike = np.flatnonzero((shorter > 0) & (longer < 1.5 * shorter))
    apart = np.flatnonzero((shorter > 0) & (longer >= 1.5 * shorter))

    def over(pick, score, form=str):
        return score([form(left[i]) for i in pick], [form(right[i]) for i in pick])

    def plain(x, y):
        return pair_scores(x, y, tokens=False)

    def token_set(x, y):
        return pair_scores(x, y, tokens=True)

    by_words = np.maximum(over(alike, plain, _sorted_words), over(alike, token_set, _word_key))
    result[alike] = np.maximum(over(alike, plain), by_words * 0.95)
    scale = np.where(longer[apart] <= 8 * shorter[apart], 0.9, 0.6)
    common = np.array([not set(left[i].split()).isdisjoint(right[i].split()) for i in apart], bool)
    windows = np.full(len(apart), 100.0)
    rest = apart[~common]
    windows[~common] = np.maximum(over(rest, partial_scores, _sorted_words), over(rest, partial_scores, _word_key))
    best = np.maximum(over(apart, partial_scores) * scale, windows * 0.95 * scale)
    result[apart] = np.maximum(over(apart, plain), best)
    return result


#: Character counts kept for each string.
MOST_COUNTS = 256


class _Bounds:
    """Upper bounds of the token-set ratio from character counts and shared tokens."""

    def __init__(self, a: Block, b: Block, alphabet: int, capped: bool = True):
        self.a, self.b = a, b
        # Rare characters share a count; the bounds only grow by that.
        alphabet = min(alphabet, MOST_COUNTS)
        small = max(a.total.max(initial=0), b.total.max(initial=0)) < 256
        self.kind = np.uint8 if small else np.int32
        self.a_count = self._count(a, alphabet)
        self.b_count = np.ascontiguousarray(self._count(b, alphabet).T)
        # capped[c][j - 1] is min(count in the right string, j), for the small counts j the left side has.
        most = np.minimum(self.a_count.max(axis=0, initial=0), 8 if capped else 0)
        self.capped = [[np.minimum(self.b_count[c], self.kind(j + 1)) for j in range(m)] for c, m in enumerate(most)]
        used = b.token >= 0
        owner = np.broadcast_to(np.arange(b.n), b.token.shape)[used]
        by_token = np.argsort(b.token[used], kind="stable")
        self.posting_token = b.token[used][by_token]
        self.posting_row = owner[by_token]
        # Tokens of many strings are kept as a 0/1 row, which adds faster than a list of places.
        token, first, times = np.unique(self.posting_token, return_index=True, return_counts=True)
        self.dense = {}
        for i in np.flatnonzero(times > b.n / 8):
            here = np.zeros(b.n, np.int32)
            here[self.posting_row[first[i] : first[i] + times[i]]] = 1
            self.dense[int(token[i])] = here

    def _count(self, block, alphabet):
        owner, _, spot = block.spots(np.arange(block.n))
        flat = np.bincount(owner * alphabet + block.char[spot] % alphabet, minlength=block.n * alphabet)
        return flat.reshape(block.n, alphabet).astype(self.kind)

    def _shared(self, rows: slice) -> np.ndarray:
        """Characters of common tokens, blanks in front included."""
        a, b = self.a, self.b
        token, size = a.token[:, rows].T, a.size[:, rows].T
        shared = np.zeros((len(token), b.n), np.int32)
        low = np.searchsorted(self.posting_token, token, side="left")
        high = np.searchsorted(self.posting_token, token, side="right")
        for i, slot in zip(*np.nonzero((size > 0) & (high > low))):
            here = self.dense.get(int(token[i, slot]))
            if here is not None:
                shared[i] += here * size[i, slot]
            else:
                shared[i, self.posting_row[low[i, slot] : high[i, slot]]] += size[i, slot]
        return shared

    def _overlap(self, rows: slice) -> np.ndarray:
        """Common characters, blanks in front included."""
        counts = self.a_count[rows]
        overlap = np.zeros((len(counts), self.b.n), self.kind)
        for i, c in zip(*np.nonzero(counts)):
            count, levels = counts[i, c], self.capped[c]
            overlap[i] += levels[count - 1] if count <= len(levels) else np.minimum(self.b_count[c], count)
        return overlap

    def of(self, rows: slice) -> np.ndarray:
        a, b = self.a, self.b
        overlap, shared = self._overlap(rows), self._shared(rows)
        len_a = a.total[rows].astype(np.float32)[:, None]
        len_b = b.total.astype(np.float32)
        # The overlap counts the blank in front, so one less is the most the LCS can be.
        bound = overlap.astype(np.float32)
        bound -= 1
        bound /= np.maximum(len_a + (len_b - 2), 1)
        contained = shared.astype(np.float32)
        size_sum = np.minimum(len_a, len_b)
        size_sum += contained
        size_sum -= 2
        np.maximum(size_sum, 1, out=size_sum)
        contained -= 1
        contained /= size_sum
        np.maximum(bound, contained, out=bound)
        bound *= 200
        bound[(len_a[:, 0] == 0)] = 0
        bound[:, len_b == 0] = 0
        self.overlap, self.shared = overlap, shared
        return bound


SLACK = 1e-2  # the bounds are single precision


def best_pairs(left: list[str], right: list[str], cutoff: np.ndarray, order: np.ndarray, k: int):
    """Per left string the ``k`` best right strings by token-set ratio.

    Only scores of at least ``cutoff`` (one per left string) count; ties go to
    the lower ``order``.  A pair is scored unless its upper bound shows that it
    cannot be among the best, so the result equals that of scoring every pair.
    Returns (left index, right index, score).
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # best[i] holds the k highest scores seen so far for left string i.
    best = np.full((len(left), k), -1.0)
    for lefts, rights in product(_parts(left), _parts(right)):
        a, b, alphabet = encode([left[i] for i in lefts], [right[i] for i in rights], tokens=True)
        bounds = _Bounds(a, b, alphabet)
        bar, high = cutoff[lefts], best[lefts]
        step = max(1, BUDGET // b.n)
        fresh = []
        for first in range(0, a.n, step):
            rows = slice(first, min(first + step, a.n))
            scored = _promising(a, b, alphabet, bounds, rows, bar[rows], high[rows], k)
            # Only the best are held: all that were scored may be as many as the pairs of the parts.
            fresh.append(_keep_best(*scored, bar, order[rights], k))
        best[lefts] = high
        row, col, score = (np.concatenate(x) for x in zip(*fresh))
        found.append(_keep_best(lefts[row], rights[col], score, cutoff, order, k))
        found = [_keep_best(*(np.concatenate(x) for x in zip(*found)), cutoff, order, k)]
    return found[0]


def pairs_between(
    left: list[str], right: list[str], low: float, high: float, order: np.ndarray, n: int, weighted: bool = False
):
    """Per left string the ``n`` right strings of lowest ``order`` that score between the bounds.

    Both bounds are exclusive.  The score is the token-set ratio of two token
    keys or, if ``weighted``, the weighted score of two strings.  Returns (left
    index, right index, score).
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lefts, rights in product(_parts(left), _parts(right)):
        x, y = [left[i] for i in lefts], [right[i] for i in rights]
        bounds = _weighted_bounds(x, y) if weighted else _Bounds(*encode(x, y, tokens=True)).of
        step = max(1, BUDGET // len(y))
        # Right strings in the wanted order, so that the first hits are the ones to keep.
        ranked = np.argsort(order[rights], kind="stable")
        for first in range(0, len(x), step):
            able = bounds(slice(first, min(first + step, len(x))))[:, ranked] > low - SLACK
            spot = np.flatnonzero(able)
            row, col = spot // len(y), ranked[spot % len(y)]
            missing = np.full(len(able), n)
            batch = 4 * n
            while len(row):
                now = _place(row) < batch
                texts = [x[i] for i in row[now] + first], [y[j] for j in col[now]]
                score = weighted_scores(*texts) if weighted else pair_scores(*texts, tokens=True)
                ok = (score > low) & (score < high)
                found.append((lefts[row[now][ok] + first], rights[col[now][ok]], score[ok]))
                missing -= np.bincount(row[now][ok], minlength=len(missing))
                later = ~now & (missing > 0)[row]
                row, col = row[later], col[later]
                batch *= 4
        row, col, score = (np.concatenate(x) for x in zip(*found))
        rank = np.lexsort((order[col], row))
        kept = rank[_place(row[rank]) < n]
        found = [(row[kept], col[kept], score[kept])]
    return found[0]


def _weighted_bounds(left: list[str], right: list[str]):
    """Function from left rows to upper bounds of their weighted scores with all right strings."""
    whole, ordered, keyed = (
        _Bounds(*encode([form(t) for t in left], [form(t) for t in right], tokens))
        for form, tokens in ((str, False), (_sorted_words, False), (_word_key, True))
    )
    len_a, len_b = (np.fromiter(map(len, side), np.float32, len(side)) for side in (left, right))

    def of(rows):
        by_chars = np.maximum(whole.of(rows), ordered.of(rows))
        by_tokens = keyed.of(rows)
        a, b = len_a[rows, None], len_b
        shorter, longer = np.minimum(a, b), np.maximum(a, b)
        alike = np.maximum(by_chars, by_tokens * np.float32(0.95))
        # A window can hold at most the characters both strings have.
        most = whole.overlap.astype(np.float32)
        least = np.minimum(keyed.a.total[rows, None], keyed.b.total) - 1
        window = 200 * most / np.maximum(least + most, 1)
        scale = np.where(longer <= 8 * shorter, np.float32(0.9), np.float32(0.6))
        window_tokens = np.where(keyed.shared > 0, 100, window) * np.float32(0.95)
        apart = np.maximum(by_chars, np.maximum(window, window_tokens) * scale)
        return np.where(shorter == 0, 0, np.where(longer < 1.5 * shorter, alike, apart))

    return of


def _promising(a, b, alphabet, bounds, rows, cutoff, best, k):
    """Score the pairs of some left strings that may still matter; ``best`` is updated in place."""
    bound = bounds.of(rows)
    first = rows.start
    found = []

    def score_where(chosen, rows_):
        spot = np.flatnonzero(chosen)
        row, col = rows_[spot // b.n], spot % b.n
        score = compare(a, b, alphabet, row + first, col, True)
        found.append((row + first, col, score))
        bound[row, col] = -1  # done
        _raise(best, row, score, k)

    def required():
        return np.maximum(cutoff, best.min(axis=1)).astype(np.float32) - np.float32(SLACK)

    probe = 3 * k
    while 2 * probe < b.n:
        need = required()
        crowded = np.flatnonzero(np.count_nonzero(bound >= need[:, None], axis=1) > 2 * probe)
        if not len(crowded):
            break
        # Score the most promising ones first; the k-th best raises the bar for the rest.
        # Every sixteenth bound tells well enough where the most promising ones begin.
        some = bound[crowded, ::16]
        at = max(1, probe * some.shape[1] // b.n)
        level = np.partition(some, some.shape[1] - at, axis=1)[:, some.shape[1] - at]
        score_where(bound[crowded] >= np.maximum(level, need[crowded])[:, None], crowded)
        probe *= 4
    score_where(bound >= required()[:, None], np.arange(len(bound)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _raise(best, row, score, k):
    """Merge new scores into the k highest per row."""
    order = np.lexsort((-score, row))
    row, score = row[order], score[order]
    place = _place(row)
    ok = place < k
    fresh = np.full(best.shape, -1.0)
    fresh[row[ok], place[ok]] = score[ok]
    both = np.concatenate([best, fresh], axis=1)
    best[:] = np.partition(both, k, axis=1)[:, k:]


def _place(row):
    """Position of each entry within its run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))


def _keep_best(row, col, score, cutoff, order, k):
    ok = score >= cutoff[row]
    row, col, score = row[ok], col[ok], score[ok]
    rank = np.lexsort((order[col], -score, row))
    row, col, score = row[rank], col[rank], score[rank]
    ok = _place(row) < k
    return row[ok], col[ok], score[ok]
