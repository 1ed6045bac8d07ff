"""Which input rows found a match, which did not, and what lower thresholds would add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.specs import CUTOFF_SHARE, SPECS
from .match import by_type, to_results

# The lower thresholds a sweep compares with the default ones.
LOWER_THRESHOLDS = {"FullName": 70.0, "LastNameAddress": 60.0, "FullAddress": 65.0}


def _default_thresholds() -> dict[str, float]:
    return {s.name: s.threshold for s in SPECS.values()}


def _names(types) -> str:
    return "array(" + ", ".join(map(text.literal, types)) + ")"


def every_type(df: DataFrame, types=None) -> DataFrame:
    """A row per match type, so that a type without any result still shows up.

    Without ``types``: the built-in types and those that ``df`` has.
    """
    named = df.sparkSession.range(1).selectExpr(f"explode({_names(SPECS if types is None else types)}) AS match_type")
    return named if types is not None else named.union(df.select("match_type")).where("match_type IS NOT NULL").distinct()


def known_types(results: DataFrame, types=None) -> tuple[str, ...]:
    """``types``, or the built-in types and those of the results; the latter reads the results once."""
    return tuple(types) if types is not None else tuple(sorted(r[0] for r in every_type(results).collect()))


def unmatched(raw_input: DataFrame, results: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Raw input rows without a result of any type, original row number first."""
    matched = results.selectExpr(f"a_row - 2 AS `{row_id}`")
    left = raw_input.join(matched, row_id, "left_anti")
    others = [f"`{c}`" for c in raw_input.columns if c != row_id]
    return left.selectExpr(f"`{row_id}` + 2 AS Original_Row_Number", *others)


def coverage(records: DataFrame, results: DataFrame, types=None) -> DataFrame:
    """Matched and unmatched input rows per match type, and over all types as ``ALL``."""
    types = known_types(results, types)
    per_type = [F.expr(f"count_if(match_type = {text.literal(t)}) AS n{i}") for i, t in enumerate(types)]
    by_row = results.groupBy("a_row").agg(*per_type, F.expr(f"count(*) AS n{len(types)}"))
    # One row per input row; everything else is a count over those rows.
    every_row = records.selectExpr("row_id + 2 AS a_row").join(by_row, "a_row", "left")
    entries = ", ".join(
        f"struct({text.literal(t)} AS match_type, count(*) AS input_rows, coalesce(sum(n{i}), 0L) AS results, "
        f"count_if(n{i} > 0) AS matched)"
        for i, t in enumerate((*types, "ALL"))
    )
    counts = every_row.agg(F.expr(f"array({entries}) AS entries")).selectExpr("inline(entries)")
    return counts.selectExpr(
        "*",
        "input_rows - matched AS unmatched",
        "round(100D * (input_rows - matched) / input_rows, 1) AS unmatched_pct",
    )


def unmatched_samples(records: DataFrame, results: DataFrame, n: int = 3, types=None) -> DataFrame:
    """The first ``n`` unmatched input rows per match type."""
    types = known_types(results, types)
    matched = results.selectExpr("match_type", "a_row - 2 AS row_id")
    wanted = records.selectExpr(
        "row_id",
        f"{text.display_name('First_Name', 'Last_Name')} AS name",
        "FullAddress AS address",
        f"explode({_names(types)}) AS match_type",
    )
    missing = wanted.join(matched, ["match_type", "row_id"], "left_anti")
    return (
        missing.selectExpr("*", "row_number() OVER (PARTITION BY match_type ORDER BY row_id) AS place")
        .where(f"place <= {int(n)}")
        .selectExpr("match_type", "place", "row_id + 2 AS a_row", "name", "address")
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """Row count of each table."""
    counts = [df.agg(F.expr("count(*) AS rows")).selectExpr(f"{text.literal(n)} AS table_name", "rows") for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def lowest_matches(results: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` lowest results."""
    return results.orderBy("match_score", "a_row", "match_type").limit(n)


def below_perfect(results: DataFrame) -> DataFrame:
    """Results below 100 per match type."""
    return results.groupBy("match_type").agg(F.expr("count_if(match_score < 100) AS below_100"))


# --- thresholds ----------------------------------------------------------


def _levels(levels: dict[str, list[float]]) -> str:
    """The thresholds of a row's match type, from the lowest up; a match type without any is an error."""
    other = "ELSE raise_error(concat('No thresholds for match type ', match_type))"
    sorted_ = {t: sorted({float(x) for x in xs}) for t, xs in levels.items()}
    cases = " ".join(f"WHEN {text.literal(t)} THEN CAST(array({', '.join(f'{x!r}D' for x in xs)}) AS ARRAY<DOUBLE>)" for t, xs in sorted_.items())
    return f"CASE match_type {cases} {other} END"


def threshold_steps(scored: DataFrame, levels: dict[str, list[float]]) -> DataFrame:
    """Candidates that are the best of their input row at some threshold, with the thresholds from ``first`` to ``last``.

    A lower threshold lets candidates in by their first-stage scores, which is the order of their ranks.  Each one that
    scores more than all before it is the best until the next such one comes in, and counts where it reaches the threshold
    itself.  So a row's best candidate is a step function of the threshold, whatever the number of thresholds.
    ``first`` and ``last`` are places from 1 in the sorted thresholds of the match type.
    """
    row = "PARTITION BY match_type, a_id ORDER BY rank"
    before = f"coalesce(max(score) OVER ({row} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
    steps = scored.selectExpr("*", f"{before} AS _before").where("score > _before").drop("_before")
    steps = steps.selectExpr("*", f"lead(stage1) OVER ({row}) AS _next", f"{_levels(levels)} AS _levels")
    let_in = f"size(filter(_levels, t -> {CUTOFF_SHARE}D * t <= %s))"
    placed = steps.selectExpr(
        "*",
        f"coalesce({let_in % '_next'}, 0) + 1 AS first",
        f"least({let_in % 'stage1'}, size(filter(_levels, t -> t <= score))) AS last",
    )
    return placed.where("first <= last").drop("_next")


def at_thresholds(scored: DataFrame, levels: dict[str, list[float]]) -> DataFrame:
    """Best matches of one scored candidate set at several thresholds.

    ``scored`` comes from :func:`match.candidates` run at the lowest threshold.
    Each level repeats the candidate cutoff, which a plain filter on a lower
    run's results would miss.  A match type without levels is an error.
    """
    steps = threshold_steps(scored, levels)
    return steps.selectExpr(*(f"`{c}`" for c in scored.columns), "explode(slice(_levels, first, last - first + 1)) AS threshold")


def matches_at(scored: DataFrame, levels: dict[str, list[float]]) -> DataFrame:
    """Number of matches per match type and threshold, in one pass for any number of thresholds."""
    steps = threshold_steps(scored, levels)
    ends = steps.selectExpr("match_type", "inline(array(struct(first AS place, 1L AS n), struct(last + 1 AS place, -1L AS n)))")
    changes = ends.groupBy("match_type", "place").agg(F.sum("n").alias("n"))
    every = every_type(scored, levels).selectExpr("match_type", f"posexplode({_levels(levels)}) AS (place, threshold)").selectExpr("match_type", "place + 1 AS place", "threshold")
    counted = every.join(changes, ["match_type", "place"], "left")
    # One row per match type and threshold.
    return counted.selectExpr("match_type", "threshold", "sum(coalesce(n, 0L)) OVER (PARTITION BY match_type ORDER BY place) AS matches")


def threshold_sweep(scored: DataFrame, current: dict[str, float] | None = None, lower=None) -> DataFrame:
    """Matches at the current and at the lower threshold per match type, and how many are gained."""
    current, lower = current or _default_thresholds(), lower or LOWER_THRESHOLDS
    found = matches_at(scored, {t: [current[t], lower[t]] for t in current})
    at = lambda values: f"coalesce(max(matches) FILTER (WHERE threshold = {by_type(values)}), 0L)"
    counts = found.groupBy("match_type").agg(F.expr(f"{at(current)} AS at_current"), F.expr(f"{at(lower)} AS at_lower"))
    return counts.selectExpr(
        "match_type",
        f"{by_type(current)} AS current_threshold",
        f"{by_type(lower)} AS lower_threshold",
        "at_current",
        "at_lower",
        "at_lower - at_current AS gained",
    )


def gained_examples(scored: DataFrame, current=None, lower=None, lowest: int = 10, n: int = 3) -> DataFrame:
    """Of the ``lowest`` results at the lower thresholds, the first ``n`` below the current ones."""
    current, lower = current or _default_thresholds(), lower or LOWER_THRESHOLDS
    results = to_results(at_thresholds(scored, {t: [lower[t]] for t in lower}))
    place = "row_number() OVER (PARTITION BY match_type ORDER BY match_score, a_row) AS place"
    # In this order the results below the current threshold come first.
    ranked = results.selectExpr("*", place).where(f"place <= {min(lowest, n)}")
    return ranked.where(f"match_score < {by_type(current)}")
