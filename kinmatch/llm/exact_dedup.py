"""Exact duplicates by two-pass Bloom filtering.

Pass one hashes every text to two slots of a bit table and finds the slots that
were hit more than once. Pass two tests each row against them: a row with a slot
of its own in the table is unique and passes straight through; only rows that
may repeat are shuffled and compared by the SHA-256 of their text. The filter
decides what is shuffled, never the result: where a corpus outgrows the table,
more rows are compared and the result is the same.

Defined cases: null text is empty text; all empty texts are equal. Of equal texts the
row with the largest id stays, a null id counting as smaller than any other; of
rows that also share the id exactly one stays. Only A-Z are lower-cased. Input
columns of any other name are carried along or ignored, never read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, lookup, slot_bitmaps, slot_is_set, whole_text

#: log2 of the largest bit table: 2^30 bits are 128 MB, the bound of what is broadcast.
LARGEST_TABLE = 30


def _slots(text: Column, bits: int) -> Column:
    """Two slots from the halves of one 64-bit hash."""
    h = F.xxhash64(text)
    mask = F.lit((1 << bits) - 1).cast("long")
    return F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))


def table_bits(rows: int, largest: int = LARGEST_TABLE) -> int:
    """Sixteen bits a row and more, from 2^15 up to the bound."""
    return max(15, min(largest, (16 * max(rows, 1)).bit_length()))


def repeated_slots(texts: DataFrame, bits: int) -> DataFrame:
    """Slots hit more than once, as bitmaps of 2^15 slots: (bucket, bitmap)."""
    hit = texts.select(F.explode(_slots(F.col("_text"), bits)).alias("slot"))
    return slot_bitmaps(hit.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1"))


def may_repeat(texts: DataFrame, bits: int) -> DataFrame:
    """`texts` with _maybe: false only if no other row has the same `_text`."""
    maps = repeated_slots(texts, bits)
    out = texts.withColumn("_slots", _slots(F.col("_text"), bits))
    for i in (0, 1):
        side = F.broadcast(maps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}")))
        bucket = F.call_function("bitmap_bucket_number", F.col("_slots")[i])
        out = out.join(side, bucket == F.col(f"_bucket{i}"), "left")
    both = slot_is_set("_bitmap0", F.col("_slots")[0]) & slot_is_set("_bitmap1", F.col("_slots")[1])
    return out.select(*texts.columns, both.alias("_maybe"))


def _digest() -> Column:
    return F.sha2(F.encode(F.col("_text"), "UTF-8"), 256)


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", largest: int = LARGEST_TABLE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(whole_text(text_col)).alias("_text"))
    marked = may_repeat(texts, table_bits(texts.count(), largest))
    small = marked.select("doc_id", _digest().alias("text_sha256"), "_maybe")
    # Row numbers break ties between equal ids; they are fixed once written.
    small = checkpoint(small.withColumn("_row", F.monotonically_increasing_id()))
    alone = small.where("not _maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = small.where("_maybe").drop("_maybe")
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row")
    groups = some.groupBy("text_sha256").agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best._row").alias("_keep_row"), "group_size")
    found = lookup(some, groups, "text_sha256", "group_size")
    found = found.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"), "text_sha256")
    return alone.unionByName(found)


def distinct_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", largest: int = LARGEST_TABLE) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    texts = docs.select(row, F.col(id_col).alias("_id"), ascii_lower(whole_text(text_col)).alias("_text"))
    marked = may_repeat(texts, table_bits(texts.count(), largest))
    order = F.struct(F.col("_id").isNotNull(), "_id")
    # Copies are reduced to one row on the map side before any of them is shuffled.
    kept = marked.where("_maybe").groupBy(_digest().alias("_key")).agg(F.max_by("_doc", order).alias("_doc"))
    return marked.where("not _maybe").select("_doc.*").unionByName(kept.select("_doc.*"))
