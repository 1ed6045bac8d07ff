"""Row-aligned comparison of two tables, and side-by-side unit patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


#: Row numbers whose rows share one digest.
BLOCK = 4096


def _block(row_id: str) -> str:
    return f"`{row_id}` div {BLOCK}"


def _digests(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Per block of row numbers: rows, and two sums of hashes of their numbers and values."""
    values = ", ".join(f"`{c}`" for c in (row_id, *columns))
    sums = [f"sum(CAST(xxhash64({seed}, {values}) AS DECIMAL(20, 0)))" for seed in (1, 2)]
    return df.groupBy(F.expr(_block(row_id)).alias("block")).agg(F.expr(f"struct(count(*), {', '.join(sums)}) AS digest"))


def differing_blocks(left: DataFrame, right: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """Blocks of row numbers in which the tables may differ; only one digest a block is shuffled, no row.

    Rows without a number are never aligned, so their block always counts.
    """
    a, b = (_digests(df, columns, row_id).selectExpr("block", f"digest AS {side}") for side, df in (("a", left), ("b", right)))
    return a.join(b, "block", "full_outer").where("block IS NULL OR NOT (a <=> b)").select("block").distinct()


def diff_tables(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows that differ, with the names of the differing columns.

    Rows are aligned by ``row_id``.  Null equals null.  A row or column that
    only one side has counts as different; ``side`` says where the row exists.

    Blocks of rows are compared by digests first (of two 64-bit hashes a row), and only rows of blocks that differ are joined.
    """
    left_columns = [c for c in left.columns if c != row_id]
    right_columns = [c for c in right.columns if c != row_id]
    common = [c for c in left_columns if c in right_columns]
    alone = [c for c in left_columns + right_columns if c not in common]
    a, b = (
        df.selectExpr(f"`{row_id}`", f"struct({', '.join(f'`{c}`' for c in common)}) AS {side}")
        for side, df in (("a", left), ("b", right))
    )
    if not alone:  # with a column too many, every row differs
        blocks = differing_blocks(left, right, common, row_id).withColumnRenamed("block", "_block")
        a, b = (df.join(blocks, F.expr(f"{_block(row_id)} <=> _block"), "left_semi") for df in (a, b))
    changed = [f"IF(a.`{c}` <=> b.`{c}`, NULL, {text.literal(c)})" for c in common] + [text.literal(c) for c in alone]
    return (
        a.join(b, row_id, "full_outer")
        .selectExpr(
            f"`{row_id}`",
            "CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS side",
            f"array_join(array_sort(array({', '.join(changed)})), ',') AS changed",
        )
        .where("side <> 'both' OR changed <> ''")
    )


def diff_summary(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row: whether the tables are identical, how many rows differ, and the first of them."""
    diff = diff_tables(left, right, row_id)
    same_columns = set(left.columns) == set(right.columns)
    found = diff.agg(F.expr("count(*) AS different_rows"), F.expr(f"min(`{row_id}`) AS first_different_row"))
    identical = f"different_rows = 0 AND {str(same_columns).lower()}"
    return found.selectExpr(f"{identical} AS is_identical", "different_rows", "first_different_row")


def compare_unit_patterns(addresses: DataFrame, key: str, address: str, patterns=None) -> DataFrame:
    """What each unit pattern finds in each address, one row per address and pattern."""
    entries = ", ".join(
        f"struct('{name}' AS pattern, regexp_extract(`{address}`, r'{regex}', 0) AS found, "
        + (f"regexp_extract(`{address}`, r'{regex}', {kind})" if kind else "''")
        + f" AS unit_type, regexp_extract(`{address}`, r'{regex}', {number}) AS unit_number)"
        for name, (regex, kind, number) in (patterns or text.UNIT_PATTERNS).items()
    )
    return addresses.selectExpr(f"`{key}`", f"`{address}` AS address", f"inline(array({entries}))")
