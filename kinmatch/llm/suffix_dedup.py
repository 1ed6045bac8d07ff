"""Removal of repeated passages by suffix arrays over shards.

A byte goes if it is covered by a string of `LENGTH` bytes that also starts earlier.

1. Shards. Each window of `LENGTH` bytes has an anchor, the 32 bytes in it with the least
   hash, so equal windows have equal anchors. Neighbouring windows with the same anchor form
   one stretch of text. Windows of anchors that occur once repeat nothing; a bounded bit
   table of the others tells which stretches to gather.
2. All but the earliest of equal stretches repeat it as a whole. Those within a document are
   found where it lies; across documents the stretches meet by two 64-bit hashes, without their text.
3. Different stretches of one anchor go to one shard. Its suffix array is built by induced
   sorting, with permuted common prefixes, and of each class of suffixes that
   agree in `LENGTH` bytes all but the earliest are repeats.
4. Anchors with more than `MOST_STRETCHES` different stretches (a common phrase, or the edge of a passage
   that very many documents share) are dealt out again by anchors of `FINER` bytes, by the same steps: what
   surrounds a phrase tells most of its places apart. Where a longer anchor still has as many,
   its windows are dealt out one by one, so that no task gets one whole.

Defined cases: null text is empty; matches never cross documents; a text of fewer than `LENGTH` bytes
stays whole; a null id counts as the smallest; rows with equal ids are ordered
by a hash of their text, and rows alike in id and text count as one document; input columns other than
the id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_filter, lookup, slot_bitmaps, whole_text
from .hashing import powers, prefix_sums, mix, range_hash, row_slices, text_bytes
from .suffix_arrays import repeats_earlier

LENGTH = 100
GRAM = 32
#: Bytes of the anchors that very frequent ones are dealt out by.
FINER = 72
#: log2 of the bit table's size: 16 MB.
TABLE_BITS = 27
MOST_STRETCHES = 2000
#: Bytes of text for one suffix array.
SHARD_BYTES = 1 << 18
#: Bytes of text whose stretches are found at once; their arrays stay in a core's cache.
SLICE_BYTES = 1 << 17
#: Spreads the places within one document over the bit table.
STEP = 40_503
STRETCH = "anchor long, stretch long, doc long, tie long, start long, n long"


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: hash of the anchor, row, first window (in `data`), number of windows."""
    windows, grams = len(data) - length + 1, length - gram + 1
    if windows < 1:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    # The least hash, at the first of its places: the upper half of a hash and the place.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[grams - span : grams - span + windows])
    anchor = least.astype(np.uint32)  # the lower half
    new = np.ones(windows, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    # Rows end stretches; windows that reach beyond their row's end are dropped.
    for edge in (offsets, offsets[1:] - length + 1):
        new[edge[(edge >= 0) & (edge < windows)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, windows))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    row, start, count = row[inside], start[inside], count[inside]
    return hashes[anchor[start]], row, start, count


def own_hashes(data: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches' bytes, and whether each is the first with these bytes in its row."""
    own = range_hash(prefix_sums(data), start, start + n + length - 1)
    first = np.zeros(len(own), bool)
    first[np.unique(mix(own + mix(row.astype(np.uint64))), return_index=True)[1]] = True
    return own, first


def _anchors(batches):
    schema = pa.schema([("anchor", pa.int64())])
    for batch in batches:
        texts = batch.column("text")
        _, offsets = text_bytes(texts)
        for a, b in row_slices(offsets, SLICE_BYTES):
            data, at = text_bytes(texts.slice(a, b - a))
            hashes, row, start, n = stretches(data, at)
            hashes = hashes[own_hashes(data, row, start, n)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], schema=schema)


def _is_set(flags: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (flags[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _cut(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """The bytes of stretches."""
    size = n + LENGTH - 1
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    flat = data[np.repeat(start - ends[:-1], size) + np.arange(int(ends[-1]))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _gather(anchors, bits: int, places=None):
    """The first of equal stretches of each row, if its anchor is in a bit table; with a table of places, only those there, with their bytes."""
    fields = [(c, pa.int64()) for c in ("anchor", "stretch", "doc", "tie", "start", "n")]
    schema = pa.schema(fields + ([("bytes", pa.binary())] if places else []))

    def run(batches):
        mask = (1 << bits) - 1
        for batch in batches:
            texts, doc, tie = batch.column("text"), batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            _, offsets = text_bytes(texts)
            for a, b in row_slices(offsets, SLICE_BYTES):
                data, at = text_bytes(texts.slice(a, b - a))
                hashes, row, start, n = stretches(data, at)
                inside = start - at[row]
                kept = _is_set(anchors.value, (hashes & np.uint64(mask)).astype(np.int64))
                if places:
                    kept &= _is_set(places.value, (tie[a:b][row] ^ (inside * STEP)) & mask)
                hashes, row, start, n, inside = (x[kept] for x in (hashes, row, start, n, inside))
                own, kept = own_hashes(data, row, start, n)  # equal stretches have equal anchors, and all passed
                if not places:
                    hashes, own, row, start, n, inside = (x[kept] for x in (hashes, own, row, start, n, inside))
                if not len(n):
                    continue
                columns = [hashes.view(np.int64), own.view(np.int64), doc[a:b][row], tie[a:b][row], inside, n]
                arrays = [pa.array(c) for c in columns]
                if places:
                    arrays.append(_cut(data, start, n))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _finer(batches):
    """Stretches by longer anchors, from those by shorter ones."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("anchor", "stretch", "doc", "tie", "start", "n")], ("bytes", pa.binary())])
    for batch in batches:
        texts, doc, tie, first = batch.column("bytes"), *[batch.column(c).to_numpy() for c in ("doc", "tie", "start")]
        _, offsets = text_bytes(texts)
        for a, b in row_slices(offsets, SLICE_BYTES):
            data, at = text_bytes(texts.slice(a, b - a))
            hashes, row, start, n = stretches(data, at, gram=FINER)
            own = range_hash(prefix_sums(data), start, start + n + LENGTH - 1)
            columns = [hashes.view(np.int64), own.view(np.int64), doc[a:b][row], tie[a:b][row], first[a:b][row] + start - at[row], n]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _cut(data, start, n)], schema=schema)


def shard_repeats(stretch_rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Ranges (doc, tie, start, stop) of repeats in stretches (doc, tie, start, bytes), each from its earliest place."""
    rows = sorted(stretch_rows, key=lambda r: r[:3])
    sizes = np.array([len(r[3]) for r in rows])
    ends = np.cumsum(sizes + 1)
    first = ends - sizes - 1
    text = np.zeros(int(ends[-1]), np.int64)
    for at, r in zip(first.tolist(), rows):
        text[at : at + len(r[3])] = np.frombuffer(r[3], np.uint8)
        text[at : at + len(r[3])] += 1
    found = repeats_earlier(text, length)
    out = []
    for at, size, (doc, tie, start, _) in zip(first.tolist(), sizes.tolist(), rows):
        inside = np.flatnonzero(found[at : at + size - length + 1])
        if len(inside):
            for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
                out.append((doc, tie, start + int(run[0]), start + int(run[-1]) + length))
    return out


def _shards(batches):
    """Rows come by anchor and stretch; whole anchors are put together up to the size of a shard.

    A row that is there several times brings its stretches as often; each counts once.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "tie", "start", "stop")])
    held, size, last = [], 0, (None, None)

    def flush():
        found = shard_repeats(held)
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    for batch in batches:
        for anchor, stretch, doc, tie, start, data in zip(*[batch.column(c).to_pylist() for c in ("anchor", "stretch", "doc", "tie", "start", "bytes")]):
            if (anchor, stretch) == last:
                continue
            if anchor != last[0] and size >= SHARD_BYTES:
                yield flush()
                held, size = [], 0
            held.append((doc, tie, start, data))
            size, last = size + len(data), (anchor, stretch)
    if held:
        yield flush()


def _bit_table(slots: DataFrame, bits: int):
    """Numbers below 2^bits, in column `slot`, as a broadcast bit table."""
    flags = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    for r in slot_bitmaps(slots.select((F.col("slot") + 1).alias("slot"))).toLocalIterator():  # 2^bits bits in all
        at = (r["bucket"] - 1) * 4096
        flags[at : at + 4096] = np.frombuffer(bytes(r["bitmap"]), np.uint8)[: len(flags) - at]
    return slots.sparkSession.sparkContext.broadcast(flags)


def repeated_ranges(texts: DataFrame, bits: int = TABLE_BITS, most: int = MOST_STRETCHES) -> DataFrame:
    """Ranges (doc, tie, start, stop) of bytes to remove, which may overlap, from rows (doc, tie, text).

    Without those stretches that repeat another one of their own document.
    """
    mask = F.lit((1 << bits) - 1).cast("long")
    often = texts.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    anchors = _bit_table(often.select(F.col("anchor").bitwiseAND(mask).alias("slot")), bits)
    found = texts.mapInArrow(_gather(anchors, bits), STRETCH)
    merged = checkpoint(_merged(found))
    chosen = checkpoint(_different(merged))
    slot = F.col("first.tie").bitwiseXOR(F.col("first.start") * STEP).bitwiseAND(mask)

    def with_bytes(part: DataFrame, rows: DataFrame) -> DataFrame:
        places = _bit_table(part.select(slot.alias("slot")), bits)
        return _at_first(rows.mapInArrow(_gather(anchors, bits, places), f"{STRETCH}, bytes binary"), part)

    few, many = chosen.where(F.col("stretches") <= most), chosen.where(F.col("stretches") > most)
    ranges = _copies(found, merged).unionByName(_sharded(with_bytes(few, texts)))
    if many.isEmpty():
        return ranges
    parts = with_bytes(many, in_filter(texts, "tie", many.select("first.tie"))).select("doc", "tie", "start", "bytes")
    parts = checkpoint(parts.mapInArrow(_finer, f"{STRETCH}, bytes binary"))
    merged = checkpoint(_merged(parts))
    chosen = checkpoint(_different(merged))
    few, many = (_at_first(parts, chosen.where(c)) for c in (F.col("stretches") <= most, F.col("stretches") > most))
    ranges = ranges.unionByName(_copies(parts, merged)).unionByName(_sharded(few))
    return ranges if many.isEmpty() else ranges.unionByName(_by_window(many))


def _place() -> Column:
    return F.struct("doc", "tie", "start")


def _merged(found: DataFrame) -> DataFrame:
    """Equal stretches of an anchor: the earliest place and the number of places."""
    return found.groupBy("anchor", "stretch").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"))


def _copies(found: DataFrame, merged: DataFrame) -> DataFrame:
    """Ranges of all but the earliest of equal stretches."""
    several = merged.where("copies > 1").select(F.struct("anchor", "stretch").alias("key"), "first", "copies")
    later = lookup(found.select(F.struct("anchor", "stretch").alias("key"), "doc", "tie", "start", "n"), several, "key", "copies")
    later = later.where(F.col("first").isNotNull() & (_place() != F.col("first")))
    return later.select("doc", "tie", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("stop"))


def _different(merged: DataFrame) -> DataFrame:
    """Different stretches of one anchor, each at its earliest place."""
    counts = merged.groupBy("anchor").agg(F.count("*").alias("stretches")).where("stretches > 1")
    return lookup(merged, counts, "anchor", "stretches").where("stretches is not null").select("anchor", "stretch", "first", "stretches")


def _at_first(found: DataFrame, chosen: DataFrame) -> DataFrame:
    return found.join(chosen, ["anchor", "stretch"]).where(_place() == F.col("first"))


def _sharded(several: DataFrame) -> DataFrame:
    """Ranges of repeats among different stretches of one anchor, by suffix arrays."""
    dealt = several.select("anchor", "stretch", "doc", "tie", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor", "stretch")
    return dealt.mapInArrow(_shards, "doc long, tie long, start long, stop long")


def _by_window(several: DataFrame) -> DataFrame:
    """The same for anchors with very many stretches: equal windows meet by their digest."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at")
    windows = several.select("doc", "tie", "start", "bytes", at)
    window = F.substring(F.col("bytes"), (F.col("at") + 1).cast("int"), F.lit(LENGTH))
    windows = windows.select("doc", "tie", (F.col("start") + F.col("at")).alias("start"), F.sha2(window, 256).alias("window"))
    earliest = windows.groupBy("window").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = lookup(windows, earliest, "window", "n").where(F.col("first").isNotNull() & (_place() != F.col("first")))
    return later.select("doc", "tie", "start", (F.col("start") + LENGTH).alias("stop"))


def _without(batches):
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        texts, starts, stops = batch.column("text"), batch.column("starts"), batch.column("stops")
        data, offsets = text_bytes(texts)
        for a, b in row_slices(offsets, SLICE_BYTES):
            part, at = text_bytes(texts.slice(a, b - a))
            _, row, start, n = stretches(part, at)
            again = ~own_hashes(part, row, start, n)[1]
            row, start, n = row[again], (start - at[row])[again], n[again]
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            rows = []
            for i in range(a, b):
                own = slice(bounds[i - a], bounds[i - a + 1])
                text = data[offsets[i] : offsets[i + 1]]
                depth = np.zeros(len(text) + 1, np.int32)
                if starts[i].is_valid:
                    np.add.at(depth, starts[i].values.to_numpy(), 1)
                    np.add.at(depth, stops[i].values.to_numpy(), -1)
                np.add.at(depth, start[own], 1)
                np.add.at(depth, start[own] + n[own] + LENGTH - 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = text[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], schema=schema)


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits: int = TABLE_BITS, most: int = MOST_STRETCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that stay."""
    text = F.encode(whole_text(text_col), "UTF-8")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("tie", F.xxhash64("text"))
    ranges = repeated_ranges(texts.select("doc", "tie", "text"), bits, most)
    # A document's ranges are no more than its windows, however often its row is there.
    lists = ranges.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    lists = lists.select("_doc", "_tie", F.col("ranges.start").alias("starts"), F.col("ranges.stop").alias("stops"))
    joined = texts.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(_without, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
