"""Merkle manifest of a dataset: a hash per row, a root per group, a root of all, and a proof per row.

Nodes of a group are numbered without gaps. They are hashed in blocks of `arity` ** `depth` consecutive nodes, one window
partition each. On level l of a block only the rows numbered by multiples of arity ** l are nodes, so a node's
siblings stand at fixed offsets: lag and lead by 1 .. arity - 1 times arity ** l, masked by the node's slot in its run and by the
run's length. The row of a run's first child hashes the run to their parent. The siblings of a row's
ancestor are those last seen on that level at or before the row, so each block is sorted once and every
level is one more window on the same order.

The blocks' roots are the nodes of the next round, until each group has one node. The groups' roots are the
nodes of one last tree. Rounds are then walked back down: a row's path is its path in its block and the path of that block.
The number of rounds grows with the logarithm of the largest group, and no task holds more than a block.

Numbers come from a range partitioning by group and order, with prefix sums of the counts per partition.

Defined cases: nulls hash as `-`; a null group comes first; null order values come first in their group; rows equal in group and
order are ordered by leaf hash, and equal rows are interchangeable; a group with one row has its leaf as root, and a
dataset with one group that group's root; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

ARITY = 2
#: Levels hashed in one block; 2 ** 10 rows fit in one window buffer.
DEPTH = 10

PATH = "array<struct<before: string, after: string>>"


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon, and the value in decimal or as it is; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return sha256_hex(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Written `rows` with _at, the place in group `_group` (not null) from 0, and _n, the group's size."""
    placed = rows.repartitionByRange(F.col("_group"), *order).sortWithinPartitions("_group", *order)
    # The ranges are drawn from a sample; written once, places and counts below see the same ones.
    placed = checkpoint(placed.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    inside = placed.groupBy("_group", "_part").agg(F.count("*").alias("_rows"), F.min("_seq").alias("_low"))
    before = Window.partitionBy("_group").orderBy("_part")  # of one group, a row per partition at most
    starts = inside.select(
        "_group",
        "_part",
        (F.sum("_rows").over(before) - F.col("_rows") - F.col("_low")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("_n"),
    )
    found = placed.join(starts, ["_group", "_part"])
    return found.withColumn("_at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def block_round(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Nodes (_group, _at, _n, _hash, ...) with _block, _path (their siblings inside the block) and _root (the block's, on its first row)."""
    span = arity**depth
    rows = nodes.withColumn("_block", F.expr(f"_at div {span}")).withColumn("_level0", F.col("_hash"))
    block = Window.partitionBy("_group", "_block").orderBy("_at")
    sides = []
    for level in range(depth):
        step, hash_ = arity**level, F.col(f"_level{level}")
        more = F.col("_n") > step  # on this level the group has several nodes
        node = more & (F.col("_at") % step == 0)
        slot = F.expr(f"(_at div {step}) % {arity}")
        # Nodes of the group on this level, and of them those in the node's run.
        run = F.least(F.lit(arity), F.expr(f"(_n + {step - 1}) div {step} - (_at div {step}) + (_at div {step}) % {arity}"))
        lags = [F.when(slot >= j, F.lag(hash_, j * step).over(block)) for j in range(arity - 1, 0, -1)]
        leads = [F.when(slot + j < run, F.lead(hash_, j * step).over(block)) for j in range(1, arity)]
        rows = rows.select(
            "*",
            F.when(node, F.struct(F.concat_ws("", *lags).alias("before"), F.concat_ws("", *leads).alias("after"))).alias(f"_side{level}"),
            F.when(F.col("_at") % (step * arity) == 0, F.when(more, sha256_hex(F.concat_ws("", hash_, *leads))).otherwise(hash_)).alias(f"_level{level + 1}"),
        ).drop(*([f"_level{level}"] if level else []))
        sides.append(F.when(more, F.last(f"_side{level}", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0))))
    path = F.filter(F.array(*sides), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "_block", path.cast(PATH).alias("_path"), F.when(F.col("_at") % span == 0, F.col(f"_level{depth}")).alias("_root"))


def tree(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """One row per group (_group, _hash: its root), and the rounds that led there, from the leaves up."""
    rounds = []
    while True:
        done = checkpoint(block_round(nodes, arity, depth))
        rounds.append(done)
        nodes = done.where(F.col("_root").isNotNull()).select("_group", F.col("_block").alias("_at"), F.expr(f"(_n + {arity**depth - 1}) div {arity**depth}").alias("_n"), F.col("_root").alias("_hash"))
        if nodes.where("_n > 1").isEmpty():
            return nodes.select("_group", "_hash"), rounds


def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Rows of the first round with _path up to the root, and the columns that `top` has for each group."""
    found = top.withColumn("_path", F.array().cast(PATH)).withColumn("_at", F.lit(0).cast("long"))
    extra = [c for c in top.columns if c != "_group"]
    for done in reversed(rounds):
        above = found.select(F.col("_group"), F.col("_at").alias("_block"), F.col("_path").alias("_above"), *extra)
        lower = done.drop("_root", *extra)
        found = lower.join(above, ["_group", "_block"]).withColumn("_path", F.concat("_path", "_above")).drop("_above", "_block")
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda h, s: sha256_hex(F.concat(s["before"], h, s["after"])))


def proof(path: Column) -> Column:
    """All siblings on a path, from the leaf up and left to right, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "lang",
    order_col: str = "doc_id",
    arity: int = ARITY,
    depth: int = DEPTH,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of `docs`: `order_col`, leaf, subroot (its group's root), root, path (siblings, from the leaf up), and `keep` as given.

    A path entry holds the run's other nodes before and after the one on the way, joined; both are empty where a
    run has one node, which is hashed all the same.
    """
    keep = keep or {}
    values = [F.col(f"`{c}`") for c in columns]
    group = F.col(f"`{group_col}`").cast("string")
    # A group name that is never null and sorts like the group, null first.
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("_group"),
        F.col(f"`{order_col}`").alias("_order"),
        leaf(values).alias("_hash"),
        *[v.alias(f"_keep_{k}") for k, v in keep.items()],
    )
    rows = numbered(checkpoint(rows), [F.col("_order").asc_nulls_first(), F.col("_hash").asc()])
    roots, rounds = tree(rows, arity, depth)
    tops = numbered(roots.select(F.lit("").alias("_group"), F.col("_hash"), F.col("_group").alias("_name")), [F.col("_name").asc()])
    root, upper = tree(tops, arity, depth)
    groups = _down(upper, root.withColumnRenamed("_hash", "_whole"))
    groups = groups.select(F.col("_name").alias("_group"), F.col("_hash").alias("_subroot"), "_whole", F.col("_path").alias("_upper"))
    found = _down(rounds, groups)
    return found.select(
        F.col("_order").alias(order_col),
        F.col("_hash").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_whole").alias("root"),
        F.concat("_path", "_upper").alias("path"),
        *[F.col(f"_keep_{k}").alias(k) for k in keep],
    )
