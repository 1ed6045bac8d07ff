"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents. In every round a queue earns its share of one
sequence, `length` times its weight, and serves the whole tokens it has earned;
the fraction left is its deficit for the next round. After r rounds a queue has
served min(all it has, floor(r * length * weight)) tokens, so the deficits of any
round are known without running the rounds before it, and tasks need only the
number of tokens that lie before each of their documents. What the rounds serve is
one stream, cut every `length` tokens. A queue that has run dry leaves its part of
the round to the others. Only the very last sequence is padded.

Sources with weights of their own have queues of their own, as have those with a 256th of all bytes
or more. The others share the queue `*rest*`, in the order of each document's fractional
place in its own source, so that at every place of the queue each source has served its
share of what it has, to within one document.

Defined cases: null text is empty and packs to the end id alone; a null source is
the queue of the empty name; a source named `*rest*` is one of those that share the queue, and a weight of
that name is the queue's; a weight for a source without documents does nothing; repeated rows are packed each; an empty table gives no rows. Input columns other than the
id, text and source are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, whole_text
from .words import encoder, text_slices

LENGTH = 4096
END_ID = 2
#: A source without a weight needs this share of all bytes for a queue of its own, so there are at most 256 of them.
LEAST_SHARE = 1 / 256
#: Weights that can be given.
MOST_WEIGHTS = 256
#: Weights are rounded to this many parts, which keeps round numbers times weights in 64 bits for 10^13 tokens.
PARTS = 1 << 18
#: Rounds times queues that are looked at together.
MOST_CELLS = 1 << 21
_REST = "*rest*"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def queues_of(docs: DataFrame, text_col: str = "text", source_col: str = "source", named: Iterable[str] = ()) -> list[str]:
    """Sources with a queue of their own: those named, at most 256, then the largest, at most 256."""
    named = sorted(set(named) - {_REST})
    if len(named) > MOST_WEIGHTS:
        raise ValueError(f"weights for {len(named)} sources; there can be {MOST_WEIGHTS}")
    size = F.sum(F.octet_length(whole_text(text_col)) + 1).alias("size")
    sources = docs.groupBy(whole_text(source_col).alias("source")).agg(size)
    total = sources.agg(F.sum("size")).first()[0] or 0
    large = sources.where((F.col("size") >= total * LEAST_SHARE) & (F.col("source") != _REST)).orderBy(F.desc("size"), "source").limit(256).collect()
    return named + [r["source"] for r in large if r["source"] not in named]


def _tokenize(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("queue", pa.string()), ("source", pa.string()), ("inside", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        part, row, served, words = TaskContext.get().partitionId(), 0, {}, encoder(path)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            queues, sources = (batch.column(c).to_pylist() for c in ("queue", "source"))
            for a, b in text_slices(batch.column("size")):
                found = words.encode(texts.slice(a, b - a).to_pylist())
                rows = []
                for tokens, queue, source in zip(found, queues[a:b], sources[a:b]):
                    n = len(tokens) + 1
                    rows.append((part, row, queue, source, served.get(source, 0), n, tokens.tobytes() + np.array([end_id], words.dtype).tobytes()))
                    row, served[source] = row + 1, served.get(source, 0) + n
                parts, numbers, names, own, inside, counts, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(numbers, pa.int64()), pa.array(names), pa.array(own), pa.array(inside), ids.slice(a, b - a), pa.array(counts), pa.array(data, pa.binary())], schema=schema)

    return run


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", named: Iterable[str] = ()) -> DataFrame:
    """Written token rows: part, row (in its part), queue, source, inside (tokens of the source before it in its part), doc_id, n, ids (packed)."""
    own = queues_of(docs, text_col, source_col, named)
    source = whole_text(source_col)
    queue = F.when(source.isin(own), source).otherwise(_REST)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), queue.alias("queue"), source.alias("source"))
    rows = rows.withColumn("size", F.octet_length("text"))
    return checkpoint(rows.mapInArrow(_tokenize(tokenizer, end_id), "part int, row long, queue string, source string, inside long, doc_id long, n long, ids binary"))


def _interleaved(rest: DataFrame, bases: DataFrame, parts: int) -> DataFrame:
    """`rest` with `first`, its rows in the order of their fractional places in their sources.

    A document takes up a part of its source, in which a hash of the source picks its place; so
    sources of one document each are spread too. Every bucket of places holds about as many tokens.
    """
    total = F.sum("tokens").over(Window.partitionBy("source"))
    slim = rest.select("part", "row", "source", "inside", "n").join(bases.withColumn("total", total), ["part", "source"])
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    at = (F.col("base") + F.col("inside") + phase * F.col("n")) / F.col("total")
    slim = slim.select("part", "row", "source", "n", at.alias("at"), F.floor(at * parts).alias("bucket"))
    sums = slim.groupBy("bucket").agg(F.sum("n").alias("tokens"))  # one row per bucket
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("bucket").orderBy("at", "source", "part", "row").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(sums, "bucket")
    return rest.join(slim.select("part", "row", (F.col("before") + F.col("within")).alias("first")), ["part", "row"])


def served(rounds: np.ndarray, weights: np.ndarray, totals: np.ndarray, length: int) -> np.ndarray:
    """Tokens that each queue has served after so many rounds: one row per round number."""
    earned = rounds[:, None] * length * weights[None, :] // weights.sum()
    return np.minimum(earned, totals[None, :])


def place(first: np.ndarray, count: np.ndarray, queue: np.ndarray, weights: np.ndarray, totals: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents that take up [first, first + count) of their queues.

    Returns the document's index, the start in it, the length and the place in the stream.
    """
    unit = int(weights.sum())
    share = weights[queue]
    # The round that serves token x is the least r with r * length * weight // unit > x.
    low = -(-((first + 1) * unit) // (length * share))
    high = -(-((first + count) * unit) // (length * share))
    n = high - low + 1
    every = np.repeat(np.arange(len(first)), n)
    rounds = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    found, most = [], max(1, MOST_CELLS // len(weights))
    for i in range(0, len(every), most):
        doc = every[i : i + most]
        after, before = (served(rounds[i : i + most] - k, weights, totals, length) for k in (0, 1))
        at = np.arange(len(doc)), queue[doc]
        a, b = np.maximum(first[doc], before[at]), np.minimum((first + count)[doc], after[at])
        given = after - before
        place_ = before.sum(1) + (np.cumsum(given, 1) - given)[at] + a - before[at]
        keep = b > a
        found.append((doc[keep], a[keep], b[keep], place_[keep]))
    doc, a, b, place_ = (np.concatenate(x) for x in zip(*found))
    # A queue's share is at most one sequence, so a piece crosses one cut at most.
    room = length - place_ % length
    over = b - a > room
    docs = np.concatenate((doc, doc[over]))
    starts = np.concatenate((a, (a + room)[over])) - first[docs]
    sizes = np.concatenate((np.minimum(b - a, room), (b - a - room)[over]))
    places = np.concatenate((place_, (place_ + room)[over]))
    order = np.lexsort((starts, docs))
    return docs[order], starts[order], sizes[order], places[order]


def _cut(names: list[str], weights: np.ndarray, totals: np.ndarray, length: int, dtype: str):
    number = {q: i for i, q in enumerate(names)}
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("queue", pa.string())])

    def run(batches):
        for batch in batches:
            queues = batch.column("queue").to_pylist()
            first, count = (batch.column(c).to_numpy().astype(np.int64) for c in ("first", "n"))
            queue = np.array([number[q] for q in queues], np.int64)
            for a in range(0, batch.num_rows, 200):
                b = min(a + 200, batch.num_rows)
                doc, start, size, place_ = place(first[a:b], count[a:b], queue[a:b], weights, totals, length)
                if not len(doc):
                    continue
                ids = [np.frombuffer(x.as_buffer(), dtype).astype("<u4").tobytes() for x in batch.column("ids").slice(a, b - a)]
                crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist())]
                columns = [batch.column("doc_id").take(pa.array(doc + a)), start, size, crc, count[doc + a], place_ // length, place_ % length, [queues[d + a] for d in doc]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def target_shares(own: dict[str, float], weights: dict[str, float]) -> dict[str, float]:
    """The given shares, and for the other queues, in proportion to what they have, what is left of the whole.

    Where nothing is left, the others are served by the least part.
    """
    given = {q: float(weights[q]) for q in own if q in weights}
    left, others = max(0.0, 1 - sum(given.values())), sum(n for q, n in own.items() if q not in given)
    return {q: given[q] if q in given else n * left / (others or 1) for q, n in own.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, weights: dict[str, float] | None = None, end_id: int = END_ID, **columns: str) -> DataFrame:
    """One row per piece of a document.

    `weights` gives target token shares by source; sources without one share what is left, in
    proportion to the tokens they have. By default all do, so every sequence has the mixture of the whole.
    """
    tokens = tokenized(docs, tokenizer, end_id, named=weights or (), **columns)
    totals = tokens.groupBy("part", "queue", "source").agg(F.sum("n").alias("tokens"))  # one row per part and source
    queues = {r["queue"]: r["n"] for r in totals.groupBy("queue").agg(F.sum("tokens").alias("n")).collect()}  # 513 at most
    names = sorted(queues)
    total = sum(queues.values()) or 1
    shares = target_shares({q: n / total for q, n in queues.items()}, weights or {})
    shares = [shares[q] for q in names]
    parts = np.array([max(1, round(PARTS * s / (sum(shares) or 1))) for s in shares], np.int64)
    sums = np.array([queues[q] for q in names], np.int64)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "source", "queue", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rest = F.col("queue") == _REST
    own = tokens.where(~rest).join(bases.where(~rest).select("part", "source", "base"), ["part", "source"])
    rows = own.select("doc_id", "queue", (F.col("base") + F.col("inside")).alias("first"), "n", "ids")
    if _REST in queues:
        buckets = max(1, tokens.rdd.getNumPartitions())
        mixed = _interleaved(tokens.where(rest), bases.where(rest).select("part", "source", "tokens", "base"), buckets)
        rows = rows.unionByName(mixed.select("doc_id", "queue", "first", "n", "ids"))
    return rows.mapInArrow(_cut(names, parts, sums, length, encoder(tokenizer).dtype), PIECES)
