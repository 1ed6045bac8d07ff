"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of aligned id pairs.

Each text is encoded by both tokenizers: as both begin a new token at a single blank between two other characters, whatever
stands around, texts are cut there, and each distinct piece is encoded once per worker. Where the bytes of the tokens, joined, are those of the text with a blank in
front, the ends of the tokens are two rising lists of byte offsets, which are intersected by galloping: every end
of the shorter list is searched in the longer one from where an earlier end was found, first by steps
that double, then by halving the last step. The searches of a batch of documents run side by side: every `STRIDE`-th end
of a document starts at the document's begin, the ends after it where that one was found.

Ends found in both lists cut the tokens into groups. The ranks at which the ends stand in the longer list tell which of its
tokens overlap each token of the shorter one: from the rank after the token's start to the rank of its end. These
overlaps are the links. A pair of ids is counted once for each document that holds it linked.

Documents keep their distinct pairs, so texts are encoded once. Pairs are counted by partial counts per task. The most
frequent pairs, a bounded number, are looked up by broadcast, the others by a shuffled join, in which no
pair is frequent any more.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
tokens: zeros and an empty text for the groups; each row counts as a document, also if rows or ids
repeat; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, whole_text
from .hashing import row_slices, text_bytes

#: Ends of a document between two that are searched from the document's begin.
STRIDE = 32
#: Pairs looked up by broadcast, at most; a pair takes some 40 bytes there.
MOST_FREQUENT = 1 << 18
#: Bytes of text that are encoded together.
SLICE = 1 << 19

# The bytes that byte-level vocabularies write as themselves; the others, in order, are written from U+0100 on.
_AS_THEMSELVES = (*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1))


_SHIFTED = [b for b in range(256) if b not in set(_AS_THEMSELVES)]


def byte_level(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for."""
    return bytes(ord(c) if ord(c) < 256 else _SHIFTED[ord(c) - 256] for c in entry)


def piece_bytes(piece: str) -> bytes:
    """The bytes that a piece with U+2581 for blanks and <0xHH> for single bytes stands for."""
    single = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode()


# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts before merging.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBE = " It's 12,345 naïve  Größen…\n\n\tthey'll <|endoftext|> x_y 東京 🙂\r\n IT'S  "


class Coder:
    """Ids of texts with a blank in front, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True  # their names in a text are plain text
            added = tokenizer.get_added_tokens_decoder()
            names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
            self.bytes = [n.encode() if i in added else byte_level(n) for i, n in enumerate(names)]
            slow = lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids
            self.ids = self._ranked({x: i for i, x in enumerate(self.bytes) if i not in added}, slow) or slow
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.bytes = [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]
            self.ids = lambda text: model.encode(text, num_threads=1)
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    @staticmethod
    def _ranked(ranks: dict[bytes, int], slow):
        """The same ids by merging in the order of the ids, which is three times as fast, where that gives the same."""
        import tiktoken

        fast = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda text: fast.encode_ordinary(" " + text)) if fast.encode_ordinary(" " + _PROBE) == slow(_PROBE) else None

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def ids_of(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The ids of pieces, one piece after the other, how many ids each has, and whether each comes back byte by byte.

        The pieces are encoded as one text. Where that gives its bytes back, the bytes tell the pieces' ends.
        """
        sizes = np.array([len(p.encode("utf-8", "surrogatepass")) + 1 for p in pieces], np.int64)
        ids = self.ids(" ".join(pieces))
        if self.joined(ids) == (" " + " ".join(pieces)).encode("utf-8", "surrogatepass"):
            ends, wanted = np.cumsum(self.size[np.array(ids, np.int64)]), np.cumsum(sizes)
            last = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if (ends[last] == wanted).all():
                return ids, np.diff(last, prepend=-1), np.ones(len(pieces), bool)
        lists = [self.ids(p) for p in pieces]
        whole = [self.joined(x) == (" " + p).encode("utf-8", "surrogatepass") for p, x in zip(pieces, lists)]
        return [i for x in lists for i in x], np.array([len(x) for x in lists], np.int64), np.array(whole, bool)


#: Pieces, and ids of pieces, that a worker remembers; beyond that it starts anew.
MOST_PIECES, MOST_IDS = 600_000, 8_000_000
#: New pieces that are encoded in one call.
TOGETHER = 4000
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Pool:
    """The ids of numbered pieces, one after the other."""

    def __init__(self) -> None:
        self.ids, self.start, self.count, self.used, self.pieces = np.zeros(1 << 12, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0, 0

    @staticmethod
    def _grown(x: np.ndarray, size: int) -> np.ndarray:
        return x if size <= len(x) else np.concatenate((x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)))

    def add(self, ids: list[int], counts: np.ndarray) -> None:
        total, pieces = len(ids), self.pieces + len(counts)
        self.ids = self._grown(self.ids, self.used + total)
        self.start, self.count = self._grown(self.start, pieces), self._grown(self.count, pieces)
        self.ids[self.used : self.used + total] = ids
        self.start[self.pieces : pieces] = self.used + np.cumsum(counts) - counts
        self.count[self.pieces : pieces] = counts
        self.used, self.pieces = self.used + total, pieces

    def of(self, pieces: np.ndarray) -> np.ndarray:
        return self.ids[_ranges(self.start[pieces], self.count[pieces])]


class Pieces(dict):
    """Numbers the pieces of texts, and knows both sides' ids of each, and which pieces come back byte by byte."""

    def __init__(self, first: Coder, second: Coder) -> None:
        super().__init__()
        self.coders, self.new = (first, second), []
        self.pools, self.whole = (_Pool(), _Pool()), np.zeros(0, bool)

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' pieces, and how many pieces each text has."""
        if len(self) > MOST_PIECES or max(p.used for p in self.pools) > MOST_IDS:
            self.clear()
            self.__init__(*self.coders)
        found = [list(map(self.__getitem__, _CUT.split(t))) for t in texts]
        new, self.new = self.new, []
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            told = [c.ids_of(part) for c in self.coders]
            for pool, (ids, counts, _) in zip(self.pools, told):
                pool.add(ids, counts)
            self.whole = np.concatenate((self.whole, told[0][2] & told[1][2]))
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())), counts


def gallop(longer: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each x the first place in `longer[low:high]` that is not below it: doubling steps from `low`, then halving."""
    low, top = low.copy(), high.copy()
    open_, step = np.flatnonzero(low < top), 1
    while len(open_):
        at = low[open_] + (step - 1)
        inside = at < top[open_]
        at, open_ = at[inside], open_[inside]
        below = longer[at] < x[open_]
        top[open_[~below]] = at[~below]
        open_ = open_[below]
        low[open_] = at[below] + 1
        step *= 2
    open_ = np.flatnonzero(low < top)
    while len(open_):
        middle = (low[open_] + top[open_]) >> 1
        below = longer[middle] < x[open_]
        low[open_[below]] = middle[below] + 1
        top[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < top[open_]]
    return low


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Aligned:
    """Groups and links of a batch of documents, given the sizes in bytes of their tokens on both sides.

    Documents have the same bytes on both sides and one token at least.
    """

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> None:
        ends = [np.cumsum(s) for s in sizes]
        begin = [np.cumsum(n) - n for n in counts]
        docs = len(counts[0])
        #: For each document the side with fewer tokens.
        self.short = (counts[1] < counts[0]).astype(np.int64)
        n_short = np.minimum(*counts)
        # Both sides' ends in one array each: the shorter list and the longer list of every document.
        spots = [[_ranges(begin[s][self.short == s ^ far], counts[s][self.short == s ^ far]) for s in (0, 1)] for far in (0, 1)]
        ends_of = [np.empty(int(n.sum()), np.int64) for n in (n_short, np.maximum(*counts))]
        start = [np.cumsum(n) - n for n in (n_short, np.maximum(*counts))]
        for far in (0, 1):
            n = (n_short, np.maximum(*counts))[far]
            for s in (0, 1):
                mine = self.short == s ^ far
                ends_of[far][_ranges(start[far][mine], n[mine])] = ends[s][spots[far][s]]
        short, longer = ends_of
        doc = np.repeat(np.arange(docs), n_short)
        place = np.arange(len(short)) - start[0][doc]
        low, high = start[1][doc], start[1][doc] + np.maximum(*counts)[doc]
        anchor = place % STRIDE == 0
        rank = low.copy()
        rank[anchor] = gallop(longer, short[anchor], low[anchor], high[anchor])
        others = np.flatnonzero(~anchor)
        rank[others] = gallop(longer, short[others], rank[others - place[others] % STRIDE], high[others])
        #: Ends that both lists have: the last of each document is one.
        self.common = longer[rank] == short
        before = np.where(place == 0, low, np.roll(rank + self.common, 1))
        #: Tokens of the longer list that overlap each token of the shorter one.
        self.first, self.overlaps = before - low + begin_of(begin, self.short, doc), rank - before + 1
        self.doc, self.token = doc, place + begin_of(begin, 1 - self.short, doc)
        self.rank = rank - low + begin_of(begin, self.short, doc)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, token of the first side, token of the second side, for each link."""
        doc = np.repeat(self.doc, self.overlaps)
        mine, other = np.repeat(self.token, self.overlaps), _ranges(self.first, self.overlaps)
        turned = self.short[doc] == 1
        return doc, np.where(turned, other, mine), np.where(turned, mine, other)

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and the last token of either side, for each group."""
        doc, mine, other = self.doc[self.common], self.token[self.common], self.rank[self.common]
        turned = self.short[doc] == 1
        return doc, np.where(turned, other, mine), np.where(turned, mine, other)


def begin_of(begin: list[np.ndarray], not_side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where the tokens of each document begin on the side that is not `not_side`."""
    return np.where(not_side == 0, begin[1], begin[0])[doc]


class GroupText:
    """Writes groups as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, sizes: tuple[int, int]) -> None:
        self.n = sum(sizes)
        ids = [str(i).encode() for size in sizes for i in range(size)]
        close = [b"|"] * sizes[0] + [b";"] * sizes[1]
        self.words = [i + b"," for i in ids] + [i + c for i, c in zip(ids, close)]
        self.offset = sizes[0]

    def of(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """One text per document; `last_a` and `last_b` are the groups' last tokens, `counts` both sides' tokens per document."""
        codes_a, codes_b = a.copy(), b + self.offset
        codes_a[last_a] += self.n
        codes_b[last_b] += self.n
        # In the whole, tokens of the second side follow those of their group's first side.
        group_a, group_b = (np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in (last_a, last_b))
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = codes_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = codes_b
        ends = np.cumsum(counts)
        return [b"".join(map(self.words.__getitem__, out[e - n : e].tolist()))[:-1] for e, n in zip(ends.tolist(), counts.tolist())]


_HELD: dict[tuple[str, str], tuple[Pieces, GroupText]] = {}


def _encoder(first: str, second: str) -> tuple[Pieces, GroupText]:
    if (first, second) not in _HELD:
        _HELD.clear()
        a, b = Coder(first), Coder(second)
        _HELD[first, second] = Pieces(a, b), GroupText((len(a.bytes), len(b.bytes)))
    return _HELD[first, second]


def _describe(texts: list[str], encoder: tuple[Pieces, GroupText]) -> dict[str, np.ndarray | list]:
    """The numbers of each text, and its distinct pairs of linked ids, those linked more than once first."""
    pieces, writer = encoder
    first, second = pieces.coders
    rows = len(texts)
    out = {c: np.zeros(rows, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    told, empty = [""] * rows, np.zeros(0, np.int64)
    numbers, n_pieces = pieces.numbers(texts)
    owner = np.repeat(np.arange(rows), n_pieces)
    good = np.array([t != "" for t in texts], bool)
    good[owner[~pieces.whole[numbers]]] = False
    same = np.flatnonzero(good)
    if not len(same):
        return out | {"groups_sha256": told, "pairs": empty, "times": empty, "n_pairs": np.zeros(rows, np.int64), "n_times": np.zeros(rows, np.int64)}
    numbers, owner = numbers[good[owner]], owner[good[owner]]
    (a, n_a), (b, n_b) = ((p.of(numbers), np.bincount(owner, p.count[numbers], rows)[same].astype(np.int64)) for p in pieces.pools)
    found = Aligned((first.size[a], second.size[b]), (n_a, n_b))
    doc, last_a, last_b = found.cuts()
    for i, text in zip(same.tolist(), writer.of(a, b, last_a, last_b, n_a + n_b)):
        told[i] = hashlib.sha256(text).hexdigest()
    link_doc, link_a, link_b = found.links()
    docs = len(same)
    for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.bincount(doc, minlength=docs)), ("n_links", np.bincount(link_doc, minlength=docs))):
        out[name][same] = values
    span = len(first.bytes) * len(second.bytes)
    keys = np.sort(link_doc * span + a[link_a] * len(second.bytes) + b[link_b])
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[new], np.diff(new, append=len(keys))
    owner = keys // span
    order = np.lexsort((times == 1, owner)) if (times > 1).any() else np.arange(len(keys))
    keys, times, owner = keys[order], times[order], owner[order]
    n_pairs, n_times = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    n_pairs[same] = np.bincount(owner, minlength=docs)
    n_times[same] = np.bincount(owner[times > 1], minlength=docs)
    return out | {"groups_sha256": told, "pairs": keys % span, "times": times[times > 1], "n_pairs": n_pairs, "n_times": n_times}


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _align(first: str, second: str, pair_type: pa.DataType):
    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))

    def run(batches):
        encoder = _encoder(first, second)
        for batch in batches:
            texts = batch.column("text")
            for start, stop in row_slices(text_bytes(texts)[1], SLICE):
                found = _describe(texts.slice(start, stop - start).to_pylist(), encoder)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        *[pa.array(found[c], pa.int64()) for c in NUMBERS],
                        pa.array(found["groups_sha256"], pa.string()),
                        lists(found["pairs"], found["n_pairs"], pair_type),
                        lists(found["times"], found["n_times"], pa.int32()),
                    ],
                    names=["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"],
                )

    return run


def aligned(docs: DataFrame, first: str, second: str, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """Written rows (node, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), and how many ids the second side has.

    A pair is first id times that number plus second id. `times` tells how often the first pairs are linked, the others are once.
    """
    sizes = [len(Coder(p).bytes) for p in (first, second)]
    wide = sizes[0] * sizes[1] > 2**31 - 1
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(f"`{text_col}`").alias("text"))
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{'long' if wide else 'int'}>, times array<int>"
    rows = slim.mapInArrow(_align(first, second, pa.int64() if wide else pa.int32()), schema)
    return checkpoint(rows.withColumn("node", F.monotonically_increasing_id())), sizes[1]


def pair_counts(entries: DataFrame, second_ids: int) -> DataFrame:
    """Written rows (pair, docs, best): documents that hold the pair, and whether no pair of its first id has more."""
    counts = checkpoint(entries.groupBy("pair").agg(F.count("*").alias("docs")).withColumn("first", F.expr(f"pair div {second_ids}")))
    most = counts.groupBy(F.col("first").alias("_first")).agg(F.max("docs").alias("_most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(most), F.col("first") == F.col("_first")).select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def least_count(counts: DataFrame, most: int = MOST_FREQUENT) -> int:
    """A number of documents that no more than `most` pairs reach, from a histogram by powers of two to the eighth."""
    step = F.floor(F.log2("docs") * 8).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # a few hundred rows at most
    total, least = 0, 2**62
    for bin_, n in bins:
        total += n
        if total > most:
            break
        least = math.ceil(2 ** (bin_ / 8) - 1e-9)
    return least


def linked_ids(docs: DataFrame, first: str, second: str, text_col: str = "text", id_col: str = "doc_id", most: int = MOST_FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, second_ids = aligned(docs, first, second, text_col, id_col)
    entries = rows.select("node", "times", F.posexplode("pairs").alias("at", "pair")).select("node", "pair", F.coalesce(F.get("times", "at"), F.lit(1)).alias("n"))
    counts = checkpoint(pair_counts(entries, second_ids))
    frequent = F.col("docs") >= least_count(counts, most)
    hot = F.broadcast(counts.where(frequent))
    rare = counts.where(~frequent)
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")]
    by_broadcast = entries.join(hot, "pair").groupBy("node").agg(*sums)
    by_shuffle = entries.join(hot, "pair", "left_anti").join(rare, "pair").groupBy("node").agg(*sums)
    total = by_broadcast.unionByName(by_shuffle).groupBy("node").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    found = rows.drop("pairs", "times").join(total, "node", "left")
    return found.select("doc_id", *NUMBERS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
