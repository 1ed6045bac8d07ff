"""Best-match join: top-k by search string, rescoring by rules, best row kept."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scorers, text
from ..plans.specs import CANDIDATES, CUTOFF_SHARE, SPECS, MatchSpec, spec_of
from ..session import written
from .lookup import look_up
from .similarity_join import Grid, most_tasks, side_of, top_k_similar

# Candidate tables of up to this many bytes are sent whole to the tasks that read the big table.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 128  # of a candidate besides its texts, with what Spark adds
PAIRS_PER_TASK = 20_000

RESULT_COLUMNS = ("match_type", "match_score", "a_row", "b_row", "name_a", "name_b", "address_a", "address_b")
NAMES = ("First_Name", "Last_Name", "FullAddress")


# --- scores --------------------------------------------------------------


def with_address_score(
    df: DataFrame, a: str, b: str, name: str = "address_score", unit_in_street_only: bool = False
) -> DataFrame:
    """Add the rule-based score of two addresses (SQL expressions); null if either is null.

    House numbers decide first: if both are present and differ, the token-set
    score is scaled down by their distance; if one is missing it is taken as it
    is.  With equal house numbers, unequal units give 0, unlike streets a capped
    share of the plain ratio, and like streets the plain ratio.

    By default a unit is looked for in the whole address, where the state ``FL``
    followed by a ZIP reads as a floor; ``unit_in_street_only`` avoids that.
    """
    kept = [f"`{c}`" for c in df.columns]

    def unit(c):
        return text.unit(f"substring_index({c}, ',', 1)" if unit_in_street_only else c)

    def street(c):
        return text.replace_all(text.street_name(c), text.MATCH_ABBREVIATIONS)

    # Every part is a column of its own, so that no expression is evaluated twice.
    parts = df.selectExpr("*", f"{a} AS _a", f"{b} AS _b").selectExpr(
        "*",
        *(f"{text.house_digits(f'_{s}')} AS _house_{s}" for s in "ab"),
        *(f"{unit(f'_{s}')} AS _unit_{s}" for s in "ab"),
        *(f"{street(f'_{s}')} AS _street_{s}" for s in "ab"),
    )
    # Digits too long for a decimal are simply far apart.
    apart = "abs(try_cast(_house_a AS DECIMAL(38, 0)) - try_cast(_house_b AS DECIMAL(38, 0)))"
    branches = parts.selectExpr(
        "*",
        f"""CASE WHEN _a IS NULL OR _b IS NULL THEN 'none'
                 WHEN _house_a IS NULL OR _house_b IS NULL THEN 'no house number'
                 WHEN _house_a = _house_b AND _unit_a <> _unit_b THEN 'other unit'
                 WHEN _house_a = _house_b THEN 'same house'
                 WHEN {apart} <= 2 THEN 'next door'
                 WHEN {apart} <= 10 THEN 'near'
                 ELSE 'far' END AS _branch""",
    )
    # A null argument keeps the kernel from scoring a pair whose branch does not need it.
    same_house, by_tokens = "_branch = 'same house'", "_branch IN ('no house number', 'next door', 'near', 'far')"
    scored = branches.select(
        "*",
        scorers.token_set_ratio(f"IF({by_tokens}, _a, NULL)", "_b").alias("_tokens"),
        scorers.ratio(f"IF({same_house}, _a, NULL)", "_b").alias("_whole"),
        scorers.token_set_ratio(f"IF({same_house}, _street_a, NULL)", "_street_b").alias("_streets"),
    )
    # Shares and caps per branch, and 78 as the least likeness of two streets.
    score = """CASE _branch WHEN 'none' THEN CAST(NULL AS DOUBLE)
                            WHEN 'no house number' THEN _tokens
                            WHEN 'other unit' THEN 0D
                            WHEN 'same house' THEN IF(_streets < 78, least(_whole * 0.7D, 65D), _whole)
                            WHEN 'next door' THEN least(_tokens * 0.8D, 85D)
                            WHEN 'near' THEN least(_tokens * 0.5D, 60D)
                            ELSE least(_tokens * 0.2D, 30D) END"""
    return scored.selectExpr(*kept, f"{score} AS `{name}`")


def combined_score(parts: Iterable[str]) -> str:
    """Mean of the parts, or 0 if any part is 0."""
    parts = list(parts)
    if len(parts) == 1:
        return parts[0]
    positive = " AND ".join(f"{p} > 0" for p in parts)
    return f"IF({positive}, ({' + '.join(parts)}) / {len(parts)}, 0D)"


def _specs(match_types) -> list[MatchSpec]:
    return [spec_of(m) for m in (match_types or SPECS.values())]


def _with_scores(pairs: DataFrame, specs: list[MatchSpec], **address_options) -> DataFrame:
    """Add the final score of every (match_type, record a, record b) row."""

    def wanted(part: str, column: str) -> str:
        types = ", ".join(text.literal(s.name) for s in specs if part in s.parts)
        return f"IF(match_type IN ({types}), {column}, NULL)"

    needed = {p for s in specs for p in s.parts}
    if "address" in needed:
        pairs = with_address_score(pairs, wanted("address", "a_FullAddress"), "b_FullAddress", **address_options)
    names = [(p, c) for p, c in (("first", "First_Name"), ("last", "Last_Name")) if p in needed]
    if names:
        pairs = pairs.select(
            "*", *(scorers.token_set_ratio(wanted(p, f"a_{c}"), f"b_{c}").alias(f"{p}_score") for p, c in names)
        )
    cases = " ".join(f"WHEN {text.literal(s.name)} THEN {combined_score(f'{p}_score' for p in s.parts)}" for s in specs)
    return pairs.selectExpr("*", f"CASE match_type {cases} END AS score")


# --- candidates ----------------------------------------------------------


def search_rows(
    df: DataFrame, specs: list[MatchSpec], cutoffs: dict[str, float] | None = None, carry: Iterable[str] = ()
) -> DataFrame:
    """One row per record and match type: (kind, id, search[, cutoff]) and the expressions in ``carry``."""
    entries = []
    for s in specs:
        cutoff = f", {float(cutoffs[s.name])!r}D AS cutoff" if cutoffs is not None else ""
        entries.append(f"struct({text.literal(s.name)} AS kind, {s.search_string()} AS search{cutoff})")
    return df.selectExpr("row_id AS id", *carry, f"inline(array({', '.join(entries)}))")


def top_k(a: DataFrame, b: DataFrame, spec: MatchSpec, k: int = CANDIDATES, cutoff: float | None = None) -> DataFrame:
    """First stage alone: (match_type, a_id, b_id, stage1, rank) of the ``k`` best master rows per input row."""
    cutoff = CUTOFF_SHARE * spec.threshold if cutoff is None else cutoff
    found = top_k_similar(search_rows(a, [spec], {spec.name: cutoff}), search_rows(b, [spec]), k)
    return found.withColumnRenamed("kind", "match_type")


def _measured(df: DataFrame) -> tuple[int, int, int]:
    """Rows, bytes of the texts, and a bound of the longest search string."""
    sizes = [f"coalesce(octet_length({c}), 0)" for c in NAMES]
    told = df.selectExpr(f"{' + '.join(sizes)} AS n").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    return told[0], told[1] or 0, (told[2] or 0) + len(NAMES)


def candidates(
    a: DataFrame,
    b: DataFrame,
    match_types=None,
    thresholds: dict[str, float] | None = None,
    k: int = CANDIDATES,
    **address_options,
) -> DataFrame:
    """The ``k`` best master rows per input row and match type, rescored.

    Both sides are measured while the plan is built: rows, bytes and longest texts, in one pass each.

    Both sides are standard records.  Rows below 0.8 · threshold in the first
    stage are left out.  Returns (match_type, a_id, b_id, stage1, rank, score)
    and both records' columns with prefixes ``a_`` and ``b_``.
    """
    specs = _specs(match_types)
    thresholds = thresholds or {}
    cutoffs = {s.name: CUTOFF_SHARE * thresholds.get(s.name, s.threshold) for s in specs}
    # The input's own columns travel with it, so only the master is looked up again.
    a_columns, b_columns = ([f"{c} AS {side}_{c}" for c in NAMES] for side in "ab")
    a_rows, a_bytes, a_longest = _measured(a)
    b_rows, _, b_longest = _measured(b)
    cores = a.sparkSession.sparkContext.defaultParallelism
    left, right = search_rows(a, specs, cutoffs, a_columns), search_rows(b, specs)
    grid = Grid.plan(side_of(left, a_rows, a_longest), side_of(right, b_rows, b_longest), cores, len(specs))
    found = top_k_similar(left, right, k, grid)
    found = found.withColumnRenamed("kind", "match_type")
    master = b.selectExpr("row_id AS b_id", *b_columns)
    # Every input row is in k candidates a match type at most, which bounds the table's bytes.
    if k * len(specs) * (a_bytes + ROW_BYTES * a_rows) <= BROADCAST_BYTES:
        pairs = master.join(F.broadcast(found), "b_id")
        # Spread by input row, so that scoring has as many tasks as it has work, however the master was read.
        tasks = min(most_tasks(cores), max(cores, math.ceil(a_rows * k * len(specs) / PAIRS_PER_TASK)))
        pairs = pairs.repartition(tasks, "match_type", "a_id")
    else:
        pairs = look_up(written(found), master, "b_id", "a_id", a_rows * k * len(specs))
    return _with_scores(pairs, specs, **address_options)


def best_of(scored: DataFrame, threshold: str, keys=("match_type", "a_id")) -> DataFrame:
    """Per key the first best-scored candidate, if its unrounded score reaches ``threshold``."""
    row = ", ".join(f"`{c}`" for c in scored.columns if c not in keys)
    best = scored.groupBy(*keys).agg(F.expr(f"max_by(struct({row}), struct(score, -rank)) AS best"))
    # Filtering only now keeps the optimizer from copying the scoring into a filter below.
    return best.selectExpr(*keys, "best.*").where(f"score > 0 AND score >= {threshold}")


def by_type(values: dict[str, float]) -> str:
    """SQL expression for a number that depends on the match type."""
    cases = " ".join(f"WHEN {text.literal(t)} THEN {float(x)!r}D" for t, x in values.items())
    return f"CASE match_type {cases} END"


def to_results(best: DataFrame) -> DataFrame:
    return best.selectExpr(
        "match_type",
        "bround(score, 2) AS match_score",
        "a_id + 2 AS a_row",
        "b_id + 2 AS b_row",
        f"{text.display_name('a_First_Name', 'a_Last_Name')} AS name_a",
        f"{text.display_name('b_First_Name', 'b_Last_Name')} AS name_b",
        "a_FullAddress AS address_a",
        "b_FullAddress AS address_b",
    )


def match(
    a: DataFrame, b: DataFrame, match_type: str | MatchSpec, threshold: float | None = None, k: int = CANDIDATES, **options
) -> DataFrame:
    """The single best master row per input row; at most one result per input row."""
    spec = spec_of(match_type)
    thresholds = {} if threshold is None else {spec.name: threshold}
    return match_all(a, b, [spec], thresholds, k, **options)


def match_all(a: DataFrame, b: DataFrame, match_types=None, thresholds=None, k: int = CANDIDATES, **options) -> DataFrame:
    """Best matches for several match types in one pass over both tables."""
    specs = _specs(match_types)
    thresholds = thresholds or {}
    scored = candidates(a, b, specs, thresholds, k, **options)
    return to_results(best_of(scored, by_type({s.name: thresholds.get(s.name, s.threshold) for s in specs})))


def by_score(results: DataFrame) -> DataFrame:
    """Best scores first; equal scores in row order."""
    return results.orderBy("match_type", F.desc("match_score"), "a_row", "b_row")


PAIR_SCORES = ("ratio", "partial", "token_sort", "token_set", "weighted", "address")


def score_pairs(pairs: DataFrame, a: str, b: str, which: Iterable[str] = PAIR_SCORES) -> DataFrame:
    """Add one column per requested score for the strings in columns ``a`` and ``b``."""
    plain = {
        "ratio": scorers.ratio,
        "partial": scorers.partial_ratio,
        "token_sort": scorers.token_sort_ratio,
        "token_set": scorers.token_set_ratio,
        "weighted": scorers.weighted_ratio,
    }
    unknown = [w for w in which if w not in PAIR_SCORES]
    if unknown:
        raise ValueError(f"Unknown score: {unknown[0]}")
    scored = pairs.select("*", *(plain[w](a, b).alias(f"{w}_score") for w in which if w in plain))
    return with_address_score(scored, a, b) if "address" in which else scored
