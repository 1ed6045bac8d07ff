"""Examples of near matches: alike, but not equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.specs import SPECS
from ..session import written
from .match import search_rows
from .similarity_join import Grid, right_keys, side_of, similar_between

# Input row numbers tried in the first round, and how much wider each further round is.
FIRST_RANGE = 64
GROWTH = 8

# The exclusive score band of a near match.
BAND = (85.0, 99.99)
# The order in which match types are tried on a pair.
TYPE_ORDER = ("FullName", "FullAddress", "LastNameAddress")


def near_matches(
    a: DataFrame,
    b: DataFrame,
    limit: int = 1,
    band: tuple[float, float] = BAND,
    input_rows: int | None = None,
    weighted: bool = True,
    row_id: str = "row_id",
) -> DataFrame:
    """The first ``limit`` pairs whose search strings score inside the band.

    Pairs are taken by input row, then master row, then match type.
    ``input_rows`` looks at that many first input rows only; by default all are.
    The score is the weighted one, or else the token-set ratio.

    Input rows are tried in ranges of their numbers, each wider than the one before, while the plan is built: pairs
    of lower rows come first, so no further range matters once ``limit`` pairs are found.
    """
    if input_rows is not None:
        a = a.where(f"{row_id} < {int(input_rows)}")
    specs = [SPECS[t] for t in TYPE_ORDER]
    tried = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPE_ORDER))
    keys = right_keys(search_rows(b, specs), limit, weighted)
    cores = a.sparkSession.sparkContext.defaultParallelism
    n_keys, longest = keys.agg(F.count("*"), F.coalesce(F.max(F.length("token_key")), F.lit(0))).first()
    right = side_of(keys.withColumnRenamed("token_key", "search"), -(-n_keys // len(specs)), longest)
    found, so_far, size = None, 0, FIRST_RANGE
    low = a.agg(F.min(row_id)).first()[0]
    while found is None or (low is not None and so_far < limit):
        # No input rows at all: one empty round gives the columns.
        some = a.where("false") if low is None else a.where(f"{row_id} >= {low} AND {row_id} < {low + size}")
        strings = search_rows(some, specs, {s.name: 0.0 for s in specs})
        n, longest = strings.agg(F.count("*"), F.coalesce(F.max(F.length("search")), F.lit(0))).first()
        grid = Grid.plan(side_of(strings, n // len(specs), longest), right, cores, len(specs))
        pairs = similar_between(strings, keys, grid, *band, limit, weighted)
        pairs = pairs.selectExpr("a_id", "b_id", "kind AS match_type", "stage1 AS score", f"CASE kind {tried} END AS tried")
        pairs = written(pairs.orderBy("a_id", "b_id", "tried").limit(limit))
        found = pairs if found is None else found.unionByName(pairs)
        so_far += pairs.count()
        if low is not None:
            low, size = a.where(f"{row_id} >= {low + size}").agg(F.min(row_id)).first()[0], size * GROWTH
    return (
        found.orderBy("a_id", "b_id", "tried")
        .limit(limit)
        .selectExpr("a_id + 2 AS a_row", "b_id + 2 AS b_row", "match_type", "bround(score, 2) AS score")
    )
