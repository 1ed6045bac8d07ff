"""Document fingerprints by one-permutation MinHash, as SQL expressions.

The runs of five words of a text are hashed once. The upper bits of a hash choose one of
`BINS` bins; each bin keeps its least hash. An empty bin takes over the hash of
another bin, the first full one in a random order of bins that belongs to the empty bin
(optimal densification), so that two texts agree in a bin with the probability of
their Jaccard similarity, however short they are. Of each bin the 8 low-order bits are kept, as two
hexadecimal digits. Unlike hashes agree in them once in 2^8; the estimate is corrected for that.

Defined cases: null text is empty; words are split at white space, in lower case; a text of fewer
than five words has all of them as its only run, so texts without words are alike; equal texts
have equal fingerprints. The next document is the one before in id order, and that of the first the
last; a null id counts as the smallest; rows with equal ids are ordered by their text's digest;
a single row is its own next. Other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
KEPT_BITS = 8
#: Bins that an empty one tries before all others are ordered.
TRIES = 6
#: Documents a bucket of neighbouring ids should have, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 14

_SHIFT = 63 - BIN_BITS


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """`rows` with the fingerprint of column `text` as column `name`."""
    words, hashes, runs, least, full = (f"_{x}_{name}" for x in ("words", "hashes", "runs", "least", "full"))
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    positive = lambda h: h.bitwiseAND(F.lit((1 << 63) - 1))
    out = rows.withColumn(words, F.split(F.lower(F.col(text)), r"\s+"))
    # Only white space at either end leaves an empty word.
    out = out.withColumn(words, F.when(F.array_contains(words, ""), F.array_remove(words, "")).otherwise(F.col(words)))
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.size(hashes) - SHINGLE)
    run = lambda i: positive(F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(SHINGLE)]))
    one = F.array(positive(F.xxhash64(hashes)))
    out = out.withColumn(runs, F.sort_array(F.when(F.size(hashes) >= SHINGLE, F.transform(at, run)).otherwise(one)))
    # Sorted, the first hash of each bin is its least.
    out = out.withColumn(least, F.filter(runs, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(runs), i - 1)))))
    out = out.withColumn(full, F.when(F.size(least) < BINS, F.map_from_entries(F.transform(least, lambda x: F.struct(bin_of(x), x)))))

    def filled(b: Column) -> Column:
        # The order of bins that belongs to an empty one: some are tried by number, the rest come by a hash.
        tried = [F.try_element_at(F.col(full), F.xxhash64(b, F.lit(i)).bitwiseAND(F.lit(BINS - 1).cast("long"))) for i in range(TRIES)]
        lent = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("order"), x.alias("hash"))))
        return F.coalesce(F.try_element_at(F.col(full), b), *tried, lent["hash"])

    bins = F.when(F.size(least) == BINS, F.col(least)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), filled))
    digits = F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1).cast("long")))), KEPT_BITS // 4, "0"))
    return out.withColumn(name, F.array_join(digits, "")).drop(words, hashes, runs, least, full)


def fingerprint_likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the texts of two fingerprints, 0 to 1."""
    width = KEPT_BITS // 4
    part = lambda c, i: F.substring(F.col(c), i * width + 1, F.lit(width))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: part(a, i) == part(b, i))) / BINS
    chance = 2.0**-KEPT_BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds above `_id`, found in two steps over a square of bounds, which fall."""
    side = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)] or [[]]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    row = F.size(F.filter(longs([r[0] for r in rows if r]), lambda b: b > F.col("_id")))
    inner = F.get(F.array(*[longs(r) for r in rows]), F.greatest(row - 1, F.lit(0)))
    return F.greatest(row - 1, F.lit(0)) * side + F.size(F.filter(inner, lambda b: b > F.col("_id")))


def with_next(rows: DataFrame, carried: dict[str, str]) -> DataFrame:
    """`rows` (with _id and _tie) with columns of the next row in falling order of _id, the last one's next being the first.

    `carried` maps columns to the names they get from the next row. Rows are dealt
    to buckets of neighbouring ids, each with a copy of the first row of the bucket after
    it. Only bounds of buckets, 2^14 at most, reach the driver.
    """
    n = rows.count()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    steps = F.array(*[F.lit(i / count) for i in range(1, count)]) if count > 1 else None
    found = rows.agg(F.percentile_approx("_id", steps, F.lit(100_000))).first()[0] if count > 1 else []
    dealt = rows.withColumn("_bucket", _bucket(sorted(set(found or []), reverse=True)))
    heads = dealt.groupBy("_bucket").agg(F.max("_id").alias("_head"))
    order = Window.orderBy("_bucket")  # one row per bucket
    last = F.max("_bucket").over(Window.partitionBy())
    heads = heads.select(F.col("_bucket").alias("_of"), "_head", F.coalesce(F.lag("_bucket").over(order), last).alias("_before"))
    told = dealt.join(F.broadcast(heads), F.col("_bucket") == F.col("_of"))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("copy"))
    told = told.withColumn("_at", F.explode(F.when(F.col("_id") == F.col("_head"), F.array(own, copy)).otherwise(F.array(own))))
    inside = Window.partitionBy("_at.bucket").orderBy("_at.copy", F.desc("_id"), "_tie")
    out = told.select(*rows.columns, "_at", *[F.lead(c).over(inside).alias(name) for c, name in carried.items()])
    return out.where("not _at.copy").drop("_at")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("_text"))
    return with_fingerprint(rows, "_text", "fingerprint").select("doc_id", F.length("_text").cast("long").alias("n_chars"), "fingerprint")


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is taken from the next document, and their likeness."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("_tie", F.xxhash64("_text"))
    rows = with_next(with_fingerprint(rows, "_text", "fingerprint"), {"_text": "_next", "fingerprint": "next_fingerprint"})
    n, half = F.length("_text"), F.floor(F.length("_text") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)))
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprint_likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprint_likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
