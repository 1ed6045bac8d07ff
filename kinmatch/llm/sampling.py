"""Sampling of SentencePiece segmentations without replacement, and decoding.

All segmentations of a text form a lattice. A piece's weight is its unigram score, or, for a BPE model,
whose scores are ranks, Zipf's law over the rank; summed from the end, the weights give
every arc its probability given the place where it starts. Adding independent
Gumbel noise to the log-probabilities of all segmentations and taking the k largest
samples k distinct ones without replacement. The noise is drawn from the top down:
a set of segmentations with a common beginning has the largest perturbed value of its members,
which bounds them exactly, so best-first (A*) search over these sets meets the k
largest in order. The best member of a set shares its value, so a popped set is
followed to the end of the text at once; the sets that branch off on the way are
kept in a queue, each drawn below the value of the set it leaves.

With the (k+1)-th value kappa, a segmentation's chance of being included is
1 - exp(-exp(log_prob - kappa)); its logarithm is the inclusion score, zero where all segmentations were sampled.

Pieces don't cross the start of a word, so lattices are built once per word and worker.
All random numbers are hashes of the row key and the place in the text: the same
row gives the same samples on any cluster.

Defined cases: null text is empty, and the empty text has one segmentation, without pieces; where a text has fewer
than k segmentations all of them come; characters without a piece, and the word mark itself, become byte pieces, so
decoding gives back every text; a null key counts as 0; equal rows have equal samples; other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .hashing import mix, prefix_sums, range_hash, row_slices, text_bytes
from .words import Numbered

MARK = "▁"
#: Distinct words that a worker remembers; beyond that it keeps the most used half, of words met more than once.
MOST_WORDS = 200_000
#: New words whose lattices are built at once.
NEW_WORDS = 2_000
#: log2 of the size of the tables that tell most strings from pieces and their beginnings.
FILTER_BITS = 20
#: Log-weight of a byte piece.
BYTE_WEIGHT = -20.0
_HELD: dict[tuple, Lattices] = {}

SAMPLES = "key long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids binary"


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((mix(x) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def _upper(keys: np.ndarray) -> np.ndarray:
    """The upper bits of hashes."""
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that a blank is put before, and how many each text has; empty texts have none.

    A word is a run of other characters with the blanks before it, a line break, or blanks that nothing follows.
    """
    parts = [(" " + t).encode() if t else b"" for t in texts]
    joined = b"".join(parts)
    data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)
    blank, line = data == 32, data == 10
    begins = line | blank
    begins[1:] &= line[1:] | ~blank[:-1]
    begins[1:] |= line[:-1]
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined)), counts


def _small_order(values: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers."""
    return np.argsort(values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values, kind="stable")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Grown:
    """An array that values are added to; its room is doubled when it is full."""

    def __init__(self, dtype: type) -> None:
        self.data, self.used = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray, over: int = 0) -> np.ndarray:
        """All values after `values` were put in place of the last `over` ones."""
        start = self.used - over
        self.used = start + len(values)
        if self.used > len(self.data):
            self.data = np.concatenate((self.data[:start], np.zeros(2 * self.used - start, self.data.dtype)))
        self.data[start : self.used] = values
        return self.data[: self.used]


class Lattices:
    """Word lattices of a SentencePiece model as flat arrays of arcs.

    States and arcs are numbered through; a state's arcs lie side by side, likeliest first.
    """

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        # A BPE model's scores are 0, -1, -2 and so on.
        ranks = np.all(scores == np.round(scores)) and scores.min() <= -len(plain) / 2
        weights = alpha * (-np.log(1 - scores) if ranks else scores)
        texts = [model.id_to_piece(i).replace(MARK, " ") for i in plain]
        keys = self._hashes(texts)
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(plain, np.int64)[order], weights[order]
        # By the upper bits of a key: the first piece with no smaller ones; and the most pieces with the same.
        upper = _upper(self.keys)
        self.first_key = np.minimum(np.searchsorted(upper, np.arange(1 << FILTER_BITS)), len(upper) - 1).astype(np.int32)
        self.most_alike = int(np.bincount(upper).max())
        self.longest = max(map(len, texts))
        stems = list({t[:i] for t in texts for i in range(1, len(t))})
        # By the upper bits of a key: whether some piece, or the beginning of a longer one, has them.
        self.may_be_piece, self.may_go_on = (np.zeros(1 << FILTER_BITS, bool) for _ in range(2))
        self.may_be_piece[upper] = True
        self.may_go_on[_upper(self._hashes(stems))] = True
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no byte pieces")
        self.dtype = "<u2" if n <= 1 << 16 else "<u4"
        # What each id decodes to; a piece that stands for nothing decodes to nothing.
        self.bytes = [b""] * n
        for i, t in zip(plain, texts):
            self.bytes[i] = t.encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.clear()

    def clear(self) -> None:
        self.words, self.uses = Numbered(), np.zeros(0, np.int64)
        types = {"first_state": np.int64, "cumulative": np.float64, "log_p": np.float64, "target": np.int32, "emits": np.int32, "first_arc": np.int64}
        self.grown = getattr(self, "grown", None) or {n: _Grown(t) for n, t in types.items()}
        for grown in self.grown.values():
            grown.used = 0  # the room stays
        self.first_state = np.zeros(0, np.int64)  # by word
        self.grown["first_arc"].add(np.zeros(1, np.int64))
        self.first_arc = np.zeros(1, np.int64)  # by state, one more at the end
        self.cumulative, self.log_p, self.target, self.emits = (np.zeros(0, t) for t in (np.float64, np.float64, np.int32, np.int32))
        # What arcs emit: ids below the number of pieces stand for themselves, the rest for the bytes of a character.
        self.spelled: dict[str, int] = {}
        self.spellings: list[list[int]] = []

    @staticmethod
    def _hashes(texts: list[str]) -> np.ndarray:
        stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
        sums = prefix_sums(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64))
        return range_hash(sums, np.concatenate(([0], stop))[:-1], stop)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, whose lattices are built where they are new."""
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        found = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[encoded.indices.to_numpy()]
        new, self.words.new = self.words.new, []
        for i in range(0, len(new), NEW_WORDS):
            self._build(new[i : i + NEW_WORDS])
        uses = np.bincount(found, minlength=len(self.words))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return found

    def forget(self, most: int) -> None:
        """Keep the `most` most used words at most, none that was met once; their uses count half from now on."""
        texts, uses = list(self.words), self.uses
        kept = np.flatnonzero(uses > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[:most]])
        # Words have their states, and states their arcs, side by side and in order.
        states = np.append(self.first_state, len(self.first_arc) - 1)
        state_counts = states[kept + 1] - states[kept]
        state = _ranges(states[kept], state_counts)
        arc_counts = self.first_arc[state + 1] - self.first_arc[state]
        arc = _ranges(self.first_arc[state], arc_counts)
        moved = np.zeros(len(self.first_arc), np.int32)
        moved[state] = np.arange(len(state))
        target, emits, cumulative, log_p = self.target[arc], self.emits[arc], self.cumulative[arc], self.log_p[arc]
        spelled, spellings, grown = self.spelled, self.spellings, self.grown
        self.clear()
        self.spelled, self.spellings, self.uses = spelled, spellings, (uses[kept] + 1) // 2
        self.words.update((texts[i], n) for n, i in enumerate(kept.tolist()))
        self.first_state = grown["first_state"].add(np.cumsum(state_counts) - state_counts)
        self.first_arc = grown["first_arc"].add(np.cumsum(arc_counts), over=0)
        self.target = grown["target"].add(np.where(target < 0, target, moved[target]))
        self.emits, self.cumulative, self.log_p = grown["emits"].add(emits), grown["cumulative"].add(cumulative), grown["log_p"].add(log_p)

    def _build(self, new: list[str]) -> None:
        text, sizes = "".join(new), np.array([len(w) for w in new])
        n, ends = len(text), np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(n)  # characters to the word's end
        sums = prefix_sums(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64))
        starts, lengths, emits, weights = [], [], [], []
        at = np.arange(n)
        for size in range(1, self.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            keys = range_hash(sums, at, at + size)
            upper = _upper(keys)
            may = np.flatnonzero(self.may_be_piece[upper])
            found, wanted = self.first_key[upper[may]], keys[may]
            is_piece = self.keys[found] == wanted
            for _ in range(self.most_alike - 1):
                miss = np.flatnonzero(~is_piece)
                found[miss] = np.minimum(found[miss] + 1, len(self.keys) - 1)
                is_piece[miss] = self.keys[found[miss]] == wanted[miss]
            may, found = may[is_piece], found[is_piece]
            hit = at[may]
            if size == 1:
                for p in np.delete(at, may).tolist():  # no piece: the character's bytes
                    starts.append([p])
                    lengths.append([1])
                    emits.append([self._spell(text[p])])
                    weights.append([BYTE_WEIGHT * len(text[p].encode())])
            starts.append(hit)
            lengths.append(np.full(len(hit), size))
            emits.append(self.ids[found])
            weights.append(self.weights[found])
            at = at[self.may_go_on[upper]]
        start, length, emit, weight = (np.concatenate(x) for x in (starts, lengths, emits, weights))
        start, length, emit = start.astype(np.int64), length.astype(np.int64), emit.astype(np.int64)
        order = _small_order(start)
        start, length, emit, weight = start[order], length[order], emit[order], weight[order]
        counts = np.bincount(start, minlength=n)
        first = np.cumsum(counts) - counts
        near = left[start]
        closing = length == near
        # Sums of weights to the word's end, from the states nearest to it on.
        order = _small_order(near)
        total = np.zeros(n + 1)
        cuts = np.flatnonzero(np.diff(near[order], prepend=0))
        starts, closes, goes, weights = start[order], closing[order], (start + length)[order], weight[order]
        for a, b in zip(cuts, np.append(cuts[1:], len(near))):
            s = starts[a:b]
            value = weights[a:b] + np.where(closes[a:b], 0.0, total[goes[a:b]])
            begin = np.flatnonzero(np.diff(s, prepend=-1))
            total[s[begin]] = np.logaddexp.reduceat(value, begin)
        log_p = weight + np.where(closing, 0.0, total[start + length]) - total[start]
        order, cumulative = np.arange(len(start)), np.ones(len(start))
        for c in np.flatnonzero(np.bincount(counts)):
            if c > 1:  # states with so many arcs, likeliest first
                arcs = first[counts == c][:, None] + np.arange(c)
                order[arcs] = best = np.take_along_axis(arcs, np.argsort(-log_p[arcs], axis=1, kind="stable"), 1)
                cumulative[arcs[:, :-1]] = np.cumsum(np.exp(log_p[best[:, :-1]]), axis=1)
        length, emit, log_p, closing = length[order], emit[order], log_p[order], closing[order]
        state, arc = len(self.first_arc) - 1, len(self.target)
        grown = self.grown
        self.first_state = grown["first_state"].add(state + ends - sizes)
        self.first_arc = grown["first_arc"].add(np.append(arc + first, arc + len(start)), over=1)
        self.target = grown["target"].add(np.where(closing, -1, state + start + length))
        self.cumulative, self.emits = grown["cumulative"].add(cumulative), grown["emits"].add(emit)
        self.log_p = grown["log_p"].add(np.minimum(log_p, 0.0))

    def _spell(self, char: str) -> int:
        if char < "\x80":
            return self.byte_ids[ord(char)]
        if char not in self.spelled:
            self.spelled[char] = len(self.bytes) + len(self.spellings)
            self.spellings.append([self.byte_ids[b] for b in char.encode()])
        return self.spelled[char]

    def id_bytes(self, arcs: np.ndarray) -> bytes:
        """The packed ids that a path emits."""
        emits = self.emits[arcs]
        if len(emits) and emits.max() >= len(self.bytes):
            emits = np.array([i for e in emits.tolist() for i in ([e] if e < len(self.bytes) else self.spellings[e - len(self.bytes)])])
        return emits.astype(self.dtype).tobytes()


class _Chain:
    """A segmentation: its arcs, the word each belongs to, and the log-probability before each."""

    __slots__ = ("arcs", "words", "before", "log_prob", "value")


def _follow(lat: Lattices, words: np.ndarray, starts: list[tuple]) -> list[_Chain]:
    """Draw segmentations to the end of their texts.

    `starts` has for each text: the range of its words in `words`, the word and state to go on from
    (-1: from the word's start), a hash for its random numbers and the log-probability so far.
    """
    sizes = np.array([b - a for a, b, *_ in starts], np.int64)
    row = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = inside + np.repeat(np.array([a for a, *_ in starts], np.int64), sizes)
    state = lat.first_state[words[word]] if len(word) else np.zeros(0, np.int64)
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    given = np.array([s for a, b, s, *_ in starts if b > a], np.int64)
    state[heads[given >= 0]] = given[given >= 0]
    seed = np.array([h for *_, h, _ in starts], np.uint64)[row] + mix(word.astype(np.uint64) - np.repeat(np.array([z[0] for *_, z, _, _ in starts], np.uint64), sizes))
    at, step, turns = np.arange(len(word)), np.uint64(0), []
    while len(at):
        u = _uniform(seed[at] + step)
        arc = lat.first_arc[state]
        low = np.flatnonzero(lat.cumulative[arc] < u)
        while len(low):
            arc[low] += 1
            low = low[lat.cumulative[arc[low]] < u[low]]
        turns.append((at, arc))
        goes = lat.target[arc]
        on = goes >= 0
        at, state = at[on], goes[on]
        step += np.uint64(1)
    at = np.concatenate([t[0] for t in turns]) if turns else np.zeros(0, np.int64)
    arcs = np.concatenate([t[1] for t in turns]) if turns else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    at, arcs = at[order], arcs[order]
    cuts = np.searchsorted(row[at], np.arange(len(starts) + 1)) if len(at) else np.zeros(len(starts) + 1, np.int64)
    sums = np.concatenate(([0.0], np.cumsum(lat.log_p[arcs])))
    out = []
    for i, (*_, before) in enumerate(starts):
        a, b = cuts[i], cuts[i + 1]
        c = _Chain()
        c.arcs, c.words = arcs[a:b], word[at[a:b]]
        c.before = sums[a:b] - sums[a] + before
        c.log_prob = float(sums[b] - sums[a] + before)
        out.append(c)
    return out


def _branches(lat: Lattices, parts: list[tuple], most: int) -> list[list[tuple[float, int]]]:
    """For each chain the largest values of sets that leave it at or after some place: (value, place in the chain).

    `parts` has for each chain: the place, its arcs and log-probabilities before from there on, its value and a hash for random numbers.
    """
    out: list[list[tuple[float, int]]] = [[] for _ in parts]
    sizes = np.array([len(p[1]) for p in parts], np.int64)
    if not sizes.sum():
        return out
    begin, value, seed = (np.repeat(np.array([p[i] for p in parts], t), sizes) for i, t in ((0, np.int64), (3, np.float64), (4, np.uint64)))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    place = begin + np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)
    arcs, before = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(lat.log_p[arcs]))
        noise = np.log(-np.log(_uniform(seed + mix(place.astype(np.uint64)))))
    below = noise - (before + rest)  # the less, the larger the value
    best = [a + (np.argpartition(below[a:b], most - 1)[:most] if b - a > most else np.arange(b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    at, own = np.concatenate(best), np.repeat(np.arange(len(parts)), [len(x) for x in best])
    # A state with one arc has nothing else.
    values = -np.logaddexp(below[at], -value[at])
    state = np.searchsorted(lat.first_arc, arcs[at], "right") - 1
    goes = (lat.first_arc[state + 1] - lat.first_arc[state] > 1) & np.isfinite(values)
    for i, v, x in zip(own[goes].tolist(), values[goes].tolist(), place[at[goes]].tolist()):
        out[i].append((v, x))
    return out


def sample_texts(lat: Lattices, texts: list[str], keys: list[int], k: int, seed: int = 0) -> list[list[tuple]]:
    """For each text up to k tuples (log_prob, perturbed, log_inclusion, packed ids), largest perturbed value first."""
    if len(lat.words) > MOST_WORDS:
        lat.forget(MOST_WORDS // 2)
    words, counts = words_of(texts)
    words = lat.numbers(words)
    ends = np.cumsum(counts)
    bounds = list(zip((ends - counts).tolist(), ends.tolist()))
    roots = mix(np.array([key & (1 << 64) - 1 for key in keys], np.uint64) + mix(np.full(1, seed, np.uint64)))
    draws = lambda turn, what: mix(roots + mix(np.array([turn * 4 + what], np.uint64)))
    chains: list[list[_Chain]] = [[] for _ in texts]
    queues: list[list] = [[] for _ in texts]
    none = np.zeros(0, np.int64)
    todo = [(i, a, -1, none, none, np.zeros(0), 0.0, -g) for i, ((a, _), g) in enumerate(zip(bounds, np.log(-np.log(_uniform(draws(0, 1)))).tolist()))]
    for turn in range(k):
        if not todo:
            break
        steps, leaving = draws(turn, 0), draws(turn, 2)
        found = _follow(lat, words, [(word, bounds[i][1], state, (bounds[i][0],), steps[i], log_p) for i, word, state, *_, log_p, _ in todo])
        branches = _branches(lat, [(len(arcs), chain.arcs, chain.before, value, leaving[i]) for (i, *_, arcs, _, _, _, value), chain in zip(todo, found)], k)
        for (i, *_, arcs, own, before, _, value), chain, sets in zip(todo, found, branches):
            if len(arcs):
                chain.arcs, chain.words, chain.before = np.append(arcs, chain.arcs), np.append(own, chain.words), np.append(before, chain.before)
            chain.value = value
            for v, at in sets:
                heapq.heappush(queues[i], (-v, turn, at, (int(chain.arcs[at]),)))
            chains[i].append(chain)
        todo = []
        if turn == k - 1:
            break
        choice, gumbel = _uniform(draws(turn + 1, 3)).tolist(), np.log(-np.log(_uniform(draws(turn + 1, 1)))).tolist()
        for i, queue in enumerate(queues):
            if not queue:
                continue
            value, of, at, taken = heapq.heappop(queue)
            chain = chains[i][of]
            state = int(np.searchsorted(lat.first_arc, taken[0], "right")) - 1
            arcs = [a for a in range(int(lat.first_arc[state]), int(lat.first_arc[state + 1])) if a not in taken]
            p = np.cumsum(np.exp(lat.log_p[arcs]))
            pick = min(int(np.searchsorted(p, choice[i] * p[-1])), len(arcs) - 1)
            arc, rest = arcs[pick], [a for a in arcs if a != arcs[pick]]
            before = float(chain.before[at])
            if rest:
                mass = float(np.logaddexp.reduce(lat.log_p[rest]))
                heapq.heappush(queue, (float(np.logaddexp(gumbel[i] - (before + mass), value)), of, at, (*taken, arc)))
            word, goes = int(chain.words[at]), int(lat.target[arc])
            todo.append((i, word if goes >= 0 else word + 1, goes, np.append(chain.arcs[:at], arc), chain.words[: at + 1], chain.before[: at + 1], before + float(lat.log_p[arc]), -value))
    out = []
    for i, of in enumerate(chains):
        kappa = -queues[i][0][0] if queues[i] and len(of) == k else -np.inf
        out.append([(c.log_prob, c.value, _log_inclusion(c.log_prob, kappa), lat.id_bytes(c.arcs)) for c in of])
    return out


def _log_inclusion(log_prob: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_prob - kappa))), also where the inner exponential is tiny or huge."""
    x = log_prob - kappa
    if x < -30:
        return float(x)
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0))))) if np.isfinite(kappa) else 0.0


def lattices(path: str, alpha: float = 1.0) -> Lattices:
    """The worker's lattices for a model file."""
    if (path, alpha) not in _HELD:
        _HELD[path, alpha] = Lattices(path, alpha)
    return _HELD[path, alpha]


def _sample(path: str, k: int, alpha: float, seed: int):
    schema = pa.schema([("key", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), *[(c, pa.float64()) for c in ("log_prob", "perturbed", "log_inclusion")], ("ids", pa.binary())])

    def run(batches):
        lat = lattices(path, alpha)
        width = np.dtype(lat.dtype).itemsize
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key")
            _, offsets = text_bytes(texts)
            for a, b in row_slices(offsets, 1 << 18):
                own = keys.slice(a, b - a).to_pylist()
                found = sample_texts(lat, texts.slice(a, b - a).to_pylist(), [x or 0 for x in own], k, seed)
                rows = [(key, n + 1, len(r[3]) // width, *r) for key, samples in zip(own, found) for n, r in enumerate(samples)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Up to k rows per document: key, sample, n_pieces, log_prob, perturbed, log_inclusion and ids, packed as 16-bit (larger models: 32-bit) numbers."""
    rows = docs.select(F.col(key_col).cast("long").alias("key"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_sample(model, k, alpha, seed), SAMPLES)


def decode(samples: DataFrame, model: str) -> DataFrame:
    """`samples` with the text of `ids` in place of them."""
    others = [c for c in samples.columns if c != "ids"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name != "ids")

    def run(batches):
        lat = lattices(model)
        sizes = np.array([len(b) for b in lat.bytes])
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(lat.bytes), np.uint8)
        for batch in batches:
            data, offsets = text_bytes(batch.column("ids"))
            for a, b in row_slices(offsets, 1 << 18):
                ids = data[offsets[a] : offsets[b]].view(lat.dtype)
                size = sizes[ids]
                ends = np.concatenate(([0], np.cumsum(size)))
                flat = pool[np.repeat(starts[ids] - ends[:-1], size) + np.arange(int(ends[-1]))]
                cuts = ends[(offsets[a : b + 1] - offsets[a]) // np.dtype(lat.dtype).itemsize]
                # The blank before the first word is the model's.
                texts = [flat[x + 1 : y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [batch.column(c).slice(a, b - a) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*others, "text"])

    return samples.mapInArrow(run, f"{fields}, text string")
