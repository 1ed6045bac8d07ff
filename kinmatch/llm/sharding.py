"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are dealt to partitions by ranges of the id. Each partition's total gives, summed over the
partitions before it, where the partition starts in the whole; a running sum
inside the partition gives where each row starts. The shard is the equal share of
all bytes in which a row starts, so a shard differs from the target by one row's
size at most. Only ids, sizes and checksums are shuffled, no text.

Defined cases: a null text has size 8 and the checksum of the empty text; null ids come
first; rows with equal ids are ordered by checksum, then size, and equal rows are
interchangeable; an empty table gives no rows. A text larger than a shard's
target leaves the shards after it shorter or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, whole_text

#: Bytes that each row counts besides its text.
ROW_BYTES = 8


def row_size(text_col: str = "text") -> Column:
    return (F.octet_length(whole_text(text_col)) + ROW_BYTES).cast("long")


def byte_shards(docs: DataFrame, shards: int = 24, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, start_byte (of the row in the whole)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_size(text_col).alias("size"), F.crc32(F.encode(whole_text(text_col), "UTF-8")).alias("text_crc32"))
    # The ranges are drawn from a sample; written once, every total below sees the same ones.
    rows = checkpoint(rows.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select(
        F.col("part"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    running = rows.select(
        "*",
        F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bytes_inside"),
        (F.row_number().over(inside) - 1).cast("long").alias("rows_inside"),
    )
    placed = running.join(F.broadcast(parts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("bytes_inside")).alias("start_byte"),
        (F.col("rows_before") + F.col("rows_inside")).alias("_rank"),
        "total",
    )
    placed = placed.select("*", F.expr(f"cast((start_byte * {shards}) div total as int)").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), "start_byte")
