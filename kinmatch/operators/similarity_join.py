"""Exact top-k similarity join by token-set ratio.

The plan, for any size of either side:

1. Reduce both sides to distinct *token keys* (sorted distinct tokens).  Rows
   with equal keys have equal scores, and of equal right rows only the ``k``
   lowest ids can ever be among the ``k`` best.  The per-key ranking is cut to
   ``k`` rows before the shuffle as well as after it, so a key that holds a
   third of the table costs no more than any other.
2. Lay the keys out on a grid of (left block, right block) cells by hash.  The
   block counts come from the tables' rows and, where strings are long, their lengths, so a cell's
   characters are bounded however large the tables are.  Both sides meet by an equi-join on the cell.
3. Where the tables are large, rare tokens give each left key a bar first, and keys with a high bar leave the
   grid: see :mod:`closed_keys`.
4. In a cell, character counts and shared tokens give an upper bound for each
   pair; only pairs that may reach the cutoff and the running k-th best are
   scored.  A cell gives out at most ``k`` rows per left key, never its pairs.
   From :data:`RUNS_FROM` pairs of rows on, tables without long strings are searched in runs of like keys instead,
   most of which a bound rules out for a left key: see :mod:`like_runs`.
5. Rank the cells' rows per left key, keep ``k``, and give them back to the left
   rows of that key.  Keys with very many left rows are salted for that join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.kernel import best_pairs, pairs_between
from ..session import written
from .closed_keys import Closing, split_closed
from .like_runs import Runs, best_by_runs, pairs_schema, pairs_table
from .lookup import HOT_KEY_ROWS, salted_join

LEFT_BLOCK = 16384
RIGHT_BLOCK = 131072
SHORT = 256  # characters of a string that counts as one of a block; longer strings count as several
CLOSE_FROM = 100_000_000_000  # pairs of rows from which bars and prefixes are worth their joins
RUNS_FROM = 1_000_000_000  # pairs of rows from which runs of like keys take the grid's place
MIN_LEFT_BLOCK = 64  # smaller blocks cost more in overhead than they gain in spread


def most_tasks(cores: int) -> int:
    """Upper limit of tasks per stage; the floor is for clusters that start small and grow."""
    return max(32 * cores, 8192)


TOKEN_KEY = text.token_key("search")


@dataclass(frozen=True)
class Side:
    """Size of one side: its rows and, from the shortest strings up, the rows of each length class.

    Class 0 has strings of up to ``SHORT`` characters, and each further class strings twice as long.
    """

    rows: int
    classes: tuple[int, ...] = ()

    def blocks(self, block: int) -> tuple[int, ...]:
        """Blocks per class, none with more characters than ``block`` strings of class 0."""
        return tuple(math.ceil(n * 2**c / block) for c, n in enumerate(self.classes or (self.rows,)))


def length_class(length: str) -> str:
    return f"CAST(ceil(log2(greatest({length}, {SHORT}) / {SHORT}D)) AS INT)"


def side_of(strings: DataFrame, rows: int, longest: int) -> Side:
    """The size of rows (kind, search): without a further look at them if none is long."""
    if longest <= SHORT:
        return Side(rows)
    counted = strings.groupBy("kind", F.expr(length_class("length(search)")).alias("class")).count()
    most = counted.groupBy("class").agg(F.max("count").alias("n")).collect()  # a row per power of two
    classes = [0] * (max((r["class"] for r in most), default=0) + 1)
    for r in most:
        classes[r["class"]] = r["n"]
    return Side(rows, tuple(classes))


@dataclass(frozen=True)
class Grid:
    """Number of hash blocks per side, what it was planned for, and which keys may leave it."""

    left: int
    right: int
    left_rows: int | None = None
    kinds: int = 1
    closing: Closing | None = None
    #: If given, the best rows are looked for in runs of like keys and not in the grid.
    runs: Runs | None = None
    #: Blocks per length class, where there are long strings; they add up to ``left`` and ``right``.
    left_classes: tuple[int, ...] = ()
    right_classes: tuple[int, ...] = ()

    @staticmethod
    def plan(left: int | Side, right: int | Side, cores: int, kinds: int = 1) -> Grid:
        left, right = (Side(x) if isinstance(x, int) else x for x in (left, right))
        lefts, rights = list(left.blocks(LEFT_BLOCK)), right.blocks(RIGHT_BLOCK)
        # With few cells, cut the left side finer so that every core has some.  The right side
        # stays whole: the more a cell sees of it, the more its k-th best rules out.
        spread = min(math.ceil(1.25 * cores / (max(1, sum(rights)) * kinds)), math.ceil(left.rows / MIN_LEFT_BLOCK))
        lefts[0] = max(lefts[0], spread)
        pairs = left.rows * right.rows
        closing = Closing() if pairs >= CLOSE_FROM else None
        classes = tuple(x if len(x) > 1 else () for x in (tuple(lefts), rights))
        # Runs count keys, not characters, so tables with long strings are left to the grid.
        runs = Runs() if pairs >= RUNS_FROM and not any(classes) else None
        return Grid(max(1, sum(lefts)), max(1, sum(rights)), left.rows, kinds, closing, runs, *classes)

    def partitions(self, cores: int) -> int:
        """Tasks that share the cells: enough to keep hashed cells apart, but not without end."""
        return min(8 * self.left * self.right * self.kinds, most_tasks(cores))

    def block(self, side: str) -> str:
        """The block of a key, as SQL."""
        hashed = "xxhash64(token_key)"
        classes = self.left_classes if side == "left" else self.right_classes
        if not classes:
            return f"CAST(pmod({hashed}, {self.left if side == 'left' else self.right}) AS INT)"
        first, cases = 0, ""
        for c, n in enumerate(classes):
            if n:
                cases += f" WHEN {c} THEN {first} + pmod({hashed}, {n})"
                first += n
        # A key can be shorter than its string, and so of a class without blocks: any block of a longer class will do.
        return f"CAST(coalesce(CASE {length_class('length(token_key)')}{cases} END, pmod({hashed}, {first})) AS INT)"


def grid_for(a: DataFrame, b: DataFrame) -> Grid:
    """Plan a grid from the sizes of two sides with a column ``search``."""
    sides = []
    for strings in (a, b):
        rows, longest = strings.agg(F.count("*"), F.coalesce(F.max(F.length("search")), F.lit(0))).first()
        sides.append(side_of(strings, rows, longest))
    return Grid.plan(*sides, a.sparkSession.sparkContext.defaultParallelism)


def _keyed(rows: DataFrame, key: str, *others: str) -> DataFrame:
    return rows.selectExpr("kind", "id", f"{key} AS token_key", *others)


def _distinct_keys(keyed: DataFrame, k: int) -> DataFrame:
    """One row per (kind, token key) with its ``k`` lowest ids in order."""
    place = "row_number() OVER (PARTITION BY kind, token_key ORDER BY id) AS place"
    kept = keyed.selectExpr("*", place).where(f"place <= {int(k)}")
    return kept.groupBy("kind", "token_key").agg(F.expr("array_sort(collect_list(id)) AS ids"))


def _cell_function(choose):
    """Turn ``choose(left keys, cutoffs, right keys, first ids)`` into a function of two Arrow tables."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        row, col, score = choose(
            left["token_key"].to_pylist(),
            left["cutoff"].to_numpy(),
            right["token_key"].to_pylist(),
            right["first_id"].to_numpy(),
        )
        return pairs_table(left, right, row, col, score)

    return cell


def _join_back(left_rows: DataFrame, best_rows: DataFrame, rows: int | None) -> DataFrame:
    """Join the best rows of every key to all left rows of that key."""
    key = ["kind", "token_key"]
    if rows is not None and rows <= HOT_KEY_ROWS:
        return left_rows.join(best_rows, key)
    return salted_join(left_rows, best_rows, key, "id", HOT_KEY_ROWS)


def top_k_similar(a: DataFrame, b: DataFrame, k: int = 10, grid: Grid | None = None) -> DataFrame:
    """For every row of ``a`` the ``k`` rows of ``b`` with the best token-set ratio.

    ``a`` has columns (kind, id, search, cutoff), ``b`` has (kind, id, search).
    Only rows of equal ``kind`` are compared, and only scores of at least
    ``cutoff`` count.  Returns (kind, a_id, b_id, stage1, rank) and whatever
    other columns ``a`` has; ties go to the lower ``b_id``.
    """

    def choose(keys, cutoffs, right_keys, first_ids):
        return best_pairs(keys, right_keys, cutoffs, first_ids, k)

    return _grid_join(a, _distinct_keys(_keyed(b, TOKEN_KEY), k), k, grid or grid_for(a, b), choose, best_first=True)


def right_keys(b: DataFrame, n: int, weighted: bool = False) -> DataFrame:
    """Written keys of ``b`` with their ``n`` lowest ids, for several calls of :func:`similar_between`."""
    return written(_distinct_keys(_keyed(b, "search" if weighted else TOKEN_KEY), n))


def similar_between(
    a: DataFrame, keys: DataFrame, grid: Grid, low: float, high: float, n: int, weighted: bool = False
) -> DataFrame:
    """For every row of ``a`` the first ``n`` rows of ``b`` that score between the bounds, both exclusive.

    ``keys`` are the :func:`right_keys` of ``b``.  The score is the token-set ratio or, if ``weighted``,
    the weighted one, which depends on the whole strings.  Columns as in :func:`top_k_similar`.
    """

    def choose(keys, cutoffs, right_keys, first_ids):
        return pairs_between(keys, right_keys, low, high, first_ids, n, weighted)

    return _grid_join(a, keys, n, grid, choose, best_first=False, key="search" if weighted else TOKEN_KEY)


def _in_cells(left: DataFrame, right: DataFrame, k: int, grid: Grid, choose, best_first: bool) -> DataFrame:
    """(kind, token_key, ids, score): the chosen pairs of every cell."""
    closed = None
    if best_first and grid.closing:
        right = written(right.withColumn("no", F.expr("element_at(ids, 1)")))
        left, closed = split_closed(left, right, k, grid.closing)

    cell = ["kind", "left_block", "right_block"]
    cells = left.selectExpr(
        "*",
        f"{grid.block('left')} AS left_block",
        f"explode(sequence(0, {grid.right - 1})) AS right_block",
    )
    blocks = right.selectExpr(
        "*",
        "element_at(ids, 1) AS first_id",
        f"{grid.block('right')} AS right_block",
        f"explode(sequence(0, {grid.left - 1})) AS left_block",
    )
    partitions = grid.partitions(left.sparkSession.sparkContext.defaultParallelism)
    scored = (
        cells.repartition(partitions, *cell)
        .groupBy(*cell)
        .cogroup(blocks.repartition(partitions, *cell).groupBy(*cell))
        .applyInArrow(_cell_function(choose), pairs_schema(right))
    )
    return scored if closed is None else scored.unionByName(closed)


def _grid_join(a: DataFrame, right: DataFrame, k: int, grid: Grid, choose, best_first: bool, key: str = TOKEN_KEY) -> DataFrame:
    carried = [f"`{c}`" for c in a.columns if c not in ("kind", "id", "search", "cutoff")]
    left_rows = _keyed(a, key, "cutoff", *carried)
    left = left_rows.groupBy("kind", "token_key").agg(F.expr("min(cutoff) AS cutoff"), F.expr("min(id) AS no"))
    if best_first and grid.runs:
        cores = a.sparkSession.sparkContext.defaultParallelism
        scored = best_by_runs(left, right, k, grid.runs, most_tasks(cores))
    else:
        scored = _in_cells(left, right, k, grid, choose, best_first)
    by_key = "PARTITION BY kind, token_key ORDER BY" + (" score DESC," if best_first else "")
    best_keys = scored.selectExpr("*", f"row_number() OVER ({by_key} element_at(ids, 1)) AS place").where(
        f"place <= {int(k)}"
    )
    best_rows = (
        best_keys.selectExpr("kind", "token_key", "explode(ids) AS b_id", "score")
        .selectExpr("*", f"row_number() OVER ({by_key} b_id) AS rank")
        .where(f"rank <= {int(k)}")
        .withColumnRenamed("score", "stage1")
    )
    pairs = _join_back(left_rows, best_rows, grid.left_rows).where("stage1 >= cutoff")
    return pairs.selectExpr("kind", "id AS a_id", "b_id", "stage1", "rank", *carried)
