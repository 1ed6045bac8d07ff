"""Near duplicates by DartMinHash signatures and banded joining.

A document is a weighted set: its runs of five words, each weighing as often as it
occurs. The likeness of two documents is the weighted Jaccard similarity, sum of
minima over sum of maxima.

Signature. Each unit of weight of each element gets darts, a Poisson process along
the rank axis that depends on nothing but the element and the unit. Darts
that fall within a document's weights and before its rank limit each carry a
random coordinate of the signature; the earliest dart per coordinate is
kept. Two documents agree in a coordinate with the probability of their likeness. The
limit is such that about k ln k + 2k darts fall in a document, whatever its
weight; where a coordinate stays empty, that document's limit is doubled.

Joining. Signatures are cut into bands; documents that agree in a band are in one bucket.
1. Every member of a bucket is compared with the bucket's first member, the one that
   shares the most buckets with others.
2. Likeness gives a distance that obeys the triangle inequality, so two members can be
   alike only if their distances to the first one differ by no more than 1 - threshold.
   Members unlike the first one are compared with those others for which that
   holds, unless they are in one class by now or their signatures agree in so few coordinates
   that it would be five standard deviations from the threshold.
Comparisons are on the whole weighted sets, their units as 32-bit numbers, so a link between two texts is lost only
if they agree in no band at all or by that margin: at likeness 0.8 that is less than 1 in 100,000. `cut=False` compares
whatever the agreement.
Classes are the connected components of the links.

Defined cases: null text is empty; words are split at ASCII blanks, in lower case; a text of fewer than
five words is one element; texts without words are all alike; equal texts and repeated
rows are in one class; the class id is the smallest doc_id in it, null only if
all are null; input columns other than the id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_filter, lookup, whole_text
from .hashing import mix, row_slices, shingle_hashes, text_bytes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4

_ONE = np.uint64(1)


def weighted_units(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each unit of weight: the j-th occurrence of an element in its row, sorted by row."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + mix(nth.astype(np.uint64))), r


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper bits."""
    return ((x >> np.uint64(11)) + _ONE).astype(np.float64) * 2.0**-53


def dart_signatures(units: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate: an array of rows x k dart numbers.

    Every row has a unit at least; `row` is sorted.
    """
    out = np.zeros((rows, k), np.uint64)
    weight = np.bincount(row, minlength=rows)
    limit = (k * math.log(k) + 2 * k) / weight
    open_ = np.arange(rows)
    while len(open_):
        number = np.full(rows, -1)
        number[open_] = np.arange(len(open_))
        mine = number[row] >= 0
        unit, at = units[mine], number[row[mine]]
        most = limit[open_]
        rank, nth, keys, ranks, darts = np.zeros(len(unit)), np.ones(1, np.uint64), [], [], []
        while len(unit):
            gap = mix(unit + mix(nth))
            rank = rank - np.log(_uniform(gap))
            inside = rank < most[at]
            unit, at, rank = unit[inside], at[inside], rank[inside]
            dart = mix(gap[inside] ^ np.uint64(0xE7037ED1A0B428DB))
            keys.append(at * k + (dart % np.uint64(k)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
            nth += _ONE
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(len(open_) * k, np.inf)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        found = np.zeros(len(open_) * k, np.uint64)
        found[key[won]] = dart[won]
        whole = np.isfinite(best.reshape(-1, k)).all(1)
        out[open_[whole]] = found.reshape(-1, k)[whole]
        open_ = open_[~whole]
        limit[open_] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    rows, k = signatures.shape
    parts = signatures.reshape(rows, bands, k // bands)
    total = np.repeat(mix(np.arange(bands, dtype=np.uint64))[None, :], rows, 0)
    for i in range(parts.shape[2]):
        total = mix(total + parts[:, :, i])
    return total.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The upper byte of each coordinate."""
    return (signatures >> np.uint64(56)).astype(np.uint8)


def least_agreement(k: int, threshold: float) -> int:
    """Five standard deviations below the agreement expected at the threshold."""
    return math.floor(k * threshold - 5 * math.sqrt(k * threshold * (1 - threshold)))


def _sign(bands: int, rows_per_band: int, shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("content", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("size", pa.int64()), ("units", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            for a, b in row_slices(offsets, 1 << 19):
                words, counts = word_hashes(*text_bytes(pc.utf8_lower(texts.slice(a, b - a))))
                hashes, row = shingle_hashes(words, counts, shingle)
                units, row = weighted_units(hashes, row)
                signatures = dart_signatures(units, row, b - a, bands * rows_per_band)
                ends, word_ends = np.cumsum(np.bincount(row, minlength=b - a)), np.cumsum(counts)
                short = (units >> np.uint64(32)).astype(np.uint32)
                sets = [np.sort(x) for x in np.split(short, ends[:-1])]
                content = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in np.split(words, word_ends[:-1])]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(band_keys(signatures, bands).ravel()))
                sketch = pa.array([x.tobytes() for x in sketches(signatures)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_md5").slice(a, b - a), pa.array(content, pa.binary()), lists, sketch, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema
                )

    return run


def signed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """Written rows: node (row number), doc_id, text_md5, content, bands, sketch, size and units (the weighted set as sorted 32-bit numbers)."""
    text = whole_text(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), text.alias("text"))
    out = slim.mapInArrow(_sign(bands, rows, shingle), "doc_id long, text_md5 string, content binary, bands array<long>, sketch binary, size long, units binary")
    return checkpoint(out.withColumn("node", F.monotonically_increasing_id()))


def common_units(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two sorted arrays; a repeated one (two units with one number) counts once for each in both."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = b[np.minimum(at, len(b) - 1)] == a
    twice = np.flatnonzero(same[1:] & (a[1:] == a[:-1]))
    if not len(twice):
        return int(same.sum())
    values, in_a = np.unique(a, return_counts=True)
    values_b, in_b = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, values_b, assume_unique=True, return_indices=True)
    return int(np.minimum(in_a[i], in_b[j]).sum())


def _compare(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])
    for batch in batches:
        left, right = batch.column("units_a"), batch.column("units_b")
        sims = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(c[i].as_buffer(), np.uint32) for c in (left, right))
            n = common_units(a, b)
            sims.append(n / (len(a) + len(b) - n))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], schema=schema)


def likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written rows (a, b, sim) for distinct pairs (a, b) of nodes."""
    pairs = checkpoint(pairs)
    wanted = in_filter(sets, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    right = wanted.select(F.col("node").alias("b"), F.col("units").alias("units_b"))
    left = wanted.select(F.col("node").alias("a"), F.col("units").alias("units_a"))
    # First members of large buckets are in column a: by then the rows carry the others' sets, and large partitions are split by size.
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "units_a", "units_b")
    return checkpoint(joined.mapInArrow(_compare, "a long, b long, sim double"))


#: Edges that one task reads at least, where there are more tasks than cores.
EDGES_PER_TASK = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) for all nodes of edges, root being the smallest.

    Alternates large-star and small-star steps, in which nodes link to the smallest
    neighbour, until every node has one link and no node that is linked to has another.
    """
    spark = edges.sparkSession

    def written(e: DataFrame) -> tuple[DataFrame, bool]:
        """Distinct edges (u, v) with u > v, in no more parts than their number asks for, and whether they are stars around their smallest nodes."""
        e = checkpoint(e.where("u <> v").distinct())
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("end")).select("end.*")
        seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
        found = seen.agg(F.sum("down").alias("edges"), F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("least") == 0))).alias("more")).first()
        parts = max(spark.sparkContext.defaultParallelism, math.ceil((found["edges"] or 0) / EDGES_PER_TASK))
        return e.coalesce(parts), not found["more"]

    e, done = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while not done:
        # Both directions, and each node with itself, for which its smallest neighbour becomes an edge.
        pairs = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("uv", "vu", "uu", "vv")]
        both = e.select(F.explode(F.array(*pairs)).alias("end")).select("end.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v >= u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("end"))
        e, done = written(small.select("end.*"))
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(signatures: DataFrame, firsts: DataFrame, threshold: float = THRESHOLD, least: int = 0) -> DataFrame:
    """Links (a, b) that join the nodes of each class of different contents; `firsts` has one node per content.

    Every node is linked with the root of its class by the first members, and such roots with one another.
    Of members unlike the first one, pairs that agree in fewer than `least` coordinates are not compared.
    """
    sets = signatures.select("node", "units")
    entries = signatures.select("node", "size", "bands").join(firsts.select("node"), "node").select("node", "size", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpoint(lookup(entries, buckets, "key", "n").where("n is not null"))
    # The member that meets most others, over all of its buckets, comes first: of a text and its edited copies the text itself.
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    shared = shared.drop("n").join(met, "node")
    heads = shared.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("node"))).alias("first"), F.count("*").alias("n"))
    heads = heads.select("key", (-F.col("first.node")).alias("head"), "n")
    stars = checkpoint(lookup(shared.drop("met"), heads, "key", "n").select("key", "node", "size", "head"))
    tested = likeness(stars.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), sets)
    links = tested.where(F.col("sim") >= threshold).select("a", "b")
    roots = components(links)
    # Members with their distance to the first one and their class so far.
    known = stars.join(tested.select(F.col("a").alias("head"), F.col("b").alias("node"), "sim"), ["head", "node"], "left")
    known = known.join(roots, "node", "left").select("key", "node", "head", "size", F.coalesce(1 - F.col("sim"), F.lit(0.0)).alias("d"), F.coalesce("root", "node").alias("root"))
    classes = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return classes.unionByName(_within_buckets(checkpoint(known), signatures, threshold, least))


#: Bytes of members of a bucket that one task holds on either side, and what a member takes besides its set.
BLOCK_BYTES, MEMBER_BYTES = 8 << 20, 400


def _within_buckets(known: DataFrame, signatures: DataFrame, threshold: float, least: int) -> DataFrame:
    """Links between the classes so far of members of a bucket of which one at least is unlike the first member.

    Members are dealt to blocks of bounded size, of which most buckets have one; each pair of blocks meets in one cell.
    Only links come out of a cell, and a pair that shares several buckets is compared in one.
    """
    reach = 1 - threshold + 1e-9
    buckets = known.groupBy("key").agg(
        F.count(F.when(F.col("d") > reach, 1)).alias("unlike"),
        F.ceil(F.sum(F.col("size") * 4 + MEMBER_BYTES) / BLOCK_BYTES).alias("blocks"),
        (F.min("root") != F.max("root")).alias("mixed"),
        F.count("*").alias("n"),
    )
    rows = lookup(known, buckets.where("mixed and unlike > 0"), "key", "n").where("blocks is not null and node <> head")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = rows.withColumn("block", block).select("key", "node", "size", "d", "root", "block", F.explode(pairs).alias("cell"))
    rows = rows.select("key", "cell.i", "cell.j", "node", "size", "d", "root", "block")
    sets = in_filter(signatures.select("node", "bands", "sketch", "units"), "node", known.where(F.col("d") > 0).select("node"))
    rows = rows.join(sets, "node").select("key", "i", "j", "node", "size", "d", "root", "block", "bands", "sketch", "units")
    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return checkpoint(cells.mapInArrow(_cells(threshold, reach, least), "a long, b long")).distinct()


def _cell_links(cell: pa.Table, threshold: float, reach: float, least: int) -> list[tuple[int, int]]:
    """Links (smaller root, larger root) between classes, each once, that members of one cell find."""
    key = cell.column("key")[0].as_py()
    node, size, d, root, block = (cell.column(c).to_numpy() for c in ("node", "size", "d", "root", "block"))
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
    units = [np.frombuffer(u, np.uint32) for u in cell.column("units").to_pylist()]
    across = cell.column("i")[0] != cell.column("j")[0]
    out = set()
    for i in np.flatnonzero(d > reach):
        # Of two members unlike the first one, the lower node looks for the other.
        may = (root != root[i]) & (np.abs(d - d[i]) <= reach) & ((d <= reach) | (node > node[i]))
        may &= np.minimum(size, size[i]) >= np.maximum(size, size[i]) * (threshold - 1e-9)
        if across:
            may &= block != block[i]
        j = np.flatnonzero(may)
        j = j[(sketch[j] == sketch[i]).sum(1) >= least] if least and len(j) else j
        # The first bucket that both are in.
        j = j[bands[i][(bands[j] == bands[i]).argmax(1)] == key] if len(j) else j
        if len(j):
            common = np.array([common_units(units[i], units[y]) for y in j])
            alike = j[common >= threshold * (size[i] + size[j] - common)]
            out.update((min(int(root[i]), int(root[y])), max(int(root[i]), int(root[y]))) for y in alike)
    return sorted(out)


def _cells(threshold: float, reach: float, least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def told(parts: list[pa.RecordBatch]):
        found = _cell_links(pa.Table.from_batches(parts), threshold, reach, least)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    def run(batches):
        held, of = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(1))))
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if held and tuple(ids[a]) != of:
                    yield from told(held)
                    held = []
                of = tuple(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from told(held)

    return run


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, cut: bool = True) -> DataFrame:
    """One row per document: doc_id, text_md5, class_id, class_size, kept (true for one of each class).

    Without `cut`, members of a bucket that are unlike its first one are compared however few coordinates agree.
    """
    rows_ = signed(docs, text_col, id_col, bands, rows, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    contents = rows_.groupBy("content").agg(F.min("node").alias("node"), F.min(order).alias("low"), F.count("*").alias("copies"))
    contents = checkpoint(contents)
    least = least_agreement(bands * rows, threshold) if cut else 0
    roots = components(linked(rows_, contents, threshold, least))
    contents = contents.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = contents.groupBy("root").agg(F.min("low").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("contents"))
    contents = lookup(contents, classes, "root", "contents").select("content", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("kept_node"), "class_size")
    found = lookup(rows_.select("node", "doc_id", "text_md5", "content"), contents, "content", "copies")
    return found.select("doc_id", "text_md5", "class_id", "class_size", (F.col("node") == F.col("kept_node")).alias("kept"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are. Rows alike in id and text stay or go together."""
    found = near_duplicates(docs, text_col, id_col, **options)
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).agg(F.max("kept").alias("_kept")).where("not _kept")
    text = F.md5(F.encode(whole_text(text_col), "UTF-8"))
    return docs.join(keys, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_md5")), "left_anti")
