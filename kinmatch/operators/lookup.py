"""Joins that look rows up by key: hot keys are split, and a large table is filtered before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 100_000  # rows of one key that one task may hold
# Bits of the filter: some for each wanted key, and 64 MB at most, the bound of what is broadcast.
BITS_PER_KEY = 16
MOST_BITS = 1 << 29
LEAST_BITS = 1 << 15


def salted_join(many: DataFrame, few: DataFrame, key: list[str], by: str, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` of a hot key are dealt by column ``by`` to several copies of the rows of ``few``."""
    # Of n rows at most n / hot_rows keys can be hot, so their list is short.
    parts = f"CAST(ceil(count(*) / {int(hot_rows)}) AS INT) AS parts"
    hot = F.broadcast(many.groupBy(*key).agg(F.expr(parts)).where("parts > 1"))
    dealt = many.join(hot, key, "left").selectExpr(*(f"`{c}`" for c in many.columns), f"CAST(pmod(xxhash64({by}), coalesce(parts, 1)) AS INT) AS salt")
    spread = few.join(hot, key, "left").selectExpr(*(f"`{c}`" for c in few.columns), "explode(sequence(0, coalesce(parts, 1) - 1)) AS salt")
    return dealt.join(spread, [*key, "salt"]).drop("salt")


def filter_bits(keys: int) -> int:
    """Size of the filter for that many keys: a power of two."""
    return max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length()))


def only_wanted(rows: DataFrame, key: str, wanted: DataFrame, bits: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, by a bitmap of hashed keys that is broadcast.

    None that is wanted is lost; what gets through must still be joined.
    """
    slot = f"CAST(xxhash64({key}) & {bits - 1} AS BIGINT)"
    maps = (
        wanted.selectExpr(f"{slot} AS slot")
        .selectExpr("bitmap_bucket_number(slot) AS bucket", "bitmap_bit_position(slot) AS bit")
        .groupBy("bucket")
        .agg(F.expr("bitmap_construct_agg(bit) AS bitmap"))
    )
    place = f"CAST(bitmap_bit_position({slot}) AS INT)"
    byte = f"CAST(conv(hex(substring(bitmap, shiftright({place}, 3) + 1, 1)), 16, 10) AS INT)"
    marked = rows.withColumn("bucket", F.expr(f"bitmap_bucket_number({slot})")).join(F.broadcast(maps), "bucket")
    return marked.where(f"({byte} & shiftleft(1, {place} & 7)) <> 0").select(*rows.columns)


def look_up(found: DataFrame, rows: DataFrame, key: str, by: str, keys: int, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Join a written table ``found`` with ``rows``, one per ``key``, of which few are wanted.

    Only rows that pass the filter are shuffled; ``keys`` bounds how many are wanted.
    """
    return salted_join(found, only_wanted(rows, key, found.select(key), filter_bits(keys)), [key], by, hot_rows)
