"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups that `lookup` serves by broadcast. No other group can hold more than one row in a thousand.
LARGEST_GROUPS = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Only on one machine, where that is unset (tests), a temporary folder is taken; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it names a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_text(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; all other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of `rows` with `groups` (one row per `key`), safe for hot keys.

    The thousand largest groups by `size` are broadcast, a bounded number of
    short rows. Their rows are spread by a salt, so that no partition of the
    join below gets more than a thousandth of all rows for one key.
    """
    values = [c for c in groups.columns if c != key]
    slim = groups.select(F.col(key).alias("_key"), F.struct(*values).alias("_found"))
    hot = groups.orderBy(F.desc(size), key).limit(LARGEST_GROUPS)
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.monotonically_increasing_id() % 100_003)
    marked = marked.withColumn("_salt", salt.cast("long"))
    # Always 0, but not a literal: the optimizer would drop a literal from the join's keys.
    slim = slim.withColumn("_cold", (F.col(f"_found.{size}") % 1).cast("long"))
    joined = marked.join(slim, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_cold")), "left")
    found = F.coalesce("_hot", "_found")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])


def slot_bitmaps(slots: DataFrame) -> DataFrame:
    """Numbers in column `slot` as bitmaps of 2^15 each: (bucket, bitmap)."""
    bucket, bit = F.expr("bitmap_bucket_number(slot)"), F.expr("bitmap_bit_position(slot)")
    return slots.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def slot_is_set(bitmap: str, slot: Column) -> Column:
    """Whether the bit of `slot` is set; false without a bitmap."""
    bit = F.call_function("bitmap_bit_position", slot).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))
    return F.coalesce(byte.bitwiseAND(flag) != 0, F.lit(False))


def in_filter(rows: DataFrame, key: str, keys: DataFrame, bits: int = 25) -> DataFrame:
    """`rows` without most of those whose key is not in `keys` (a column of the same name).

    A filter of 2^bits bits at most is broadcast (4 MB by default); what it lets through must still be joined.
    """
    slot = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    maps = slot_bitmaps(keys.select(slot.alias("slot"))).select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    found = rows.join(F.broadcast(maps), F.call_function("bitmap_bucket_number", slot) == F.col("_bucket"))
    return found.where(slot_is_set("_bitmap", slot)).select(*rows.columns)
