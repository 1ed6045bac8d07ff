"""Score reports and rule-based audits of match results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scorers, text
from .coverage import every_type

# Score levels of the distribution report.
LEVELS = (100, 95, 90, 85, 80, 75, 70)


def score_summary(results: DataFrame, types=None) -> DataFrame:
    """Count, lowest, highest and mean score per match type; a type without results has count 0."""
    stats = results.groupBy("match_type").agg(
        F.expr("count(*) AS n"),
        F.expr("min(match_score) AS min_score"),
        F.expr("max(match_score) AS max_score"),
        F.expr("round(avg(match_score), 2) AS avg_score"),
    )
    joined = every_type(results, types).join(stats, "match_type", "left")
    return joined.selectExpr("match_type", "coalesce(n, 0L) AS matches", "min_score", "max_score", "avg_score")


def score_distribution(results: DataFrame, levels=LEVELS) -> DataFrame:
    """How many results, and which share, reach each level, per match type."""
    # Counted in one aggregation, then turned to rows: the results are not multiplied by the levels.
    entries = ", ".join(f"struct({x} AS level, count_if(match_score >= {x}) AS matches)" for x in levels)
    wide = results.groupBy("match_type").agg(F.expr("count(*) AS total"), F.expr(f"array({entries}) AS entries"))
    return wide.selectExpr("match_type", "total", "inline(entries)").selectExpr(
        "match_type", "level", "matches", "round(100D * matches / total, 1) AS pct"
    )


# --- audits: problem names, score bounds and distances are fixed values ---

SAME_HOUSE = "(house_a = house_b AND house_a <> 0)"  # house number zero counts as none
OTHER_STREET = "street_a <> street_b"
OTHER_UNIT_TYPE = (
    "(unit_a <> '' AND unit_b <> '' AND substring_index(unit_a, ' ', 1) <> substring_index(unit_b, ' ', 1))"
)


def _unrelated(part: str) -> str:
    """Different, and neither contains the other (an empty text is contained in every text)."""
    a, b = f"{part}_a", f"{part}_b"
    return f"({a} <> {b} AND NOT contains({a}, {b}) AND NOT contains({b}, {a}))"


def _with_parts(results: DataFrame, piece=text.third_last_piece) -> DataFrame:
    """Add the parts the rules look at, each evaluated once."""
    parts = {
        "house": lambda s: text.house_number(f"address_{s}"),
        "street": lambda s: text.street_name(f"address_{s}"),
        "unit": lambda s: text.unit_label(f"address_{s}"),
        "piece": lambda s: piece(f"address_{s}"),
        "first": lambda s: text.first_word(f"name_{s}"),
        "last": lambda s: text.last_word(f"name_{s}"),
    }
    return results.selectExpr("*", *(f"{f(s)} AS {n}_{s}" for n, f in parts.items() for s in "ab"))


def _flag(df: DataFrame, columns: list[str], rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``problems``: for every (problem, condition, part) rule that holds, its name and the two parts."""
    found = ", ".join(
        f"IF({condition}, struct('{problem}' AS problem, CAST({part}_a AS STRING) AS part_a, "
        f"CAST({part}_b AS STRING) AS part_b), NULL)"
        for problem, condition, part in rules
    )
    return df.selectExpr(*(f"`{c}`" for c in columns), f"array_compact(array({found})) AS problems")


def audit_first(results: DataFrame, true_city: bool = False) -> DataFrame:
    """Add ``problems`` by the first rule set: four rules for every match type; a result may break several.

    The city rule compares the third comma piece from the end, which is the
    street line in ``STREET, CITY, ST ZIP``; ``true_city`` compares the city.
    """
    far = "(house_a <> 0 AND house_b <> 0 AND abs(house_a - house_b) > 50)"
    rules = [
        ("same_house_diff_street", f"{SAME_HOUSE} AND {OTHER_STREET} AND match_score > 70", "street"),
        ("diff_property_types", f"{OTHER_UNIT_TYPE} AND match_score > 50", "unit"),
        ("diff_house_numbers", f"{far} AND match_score > 70", "house"),
        ("diff_cities", "piece_a <> piece_b AND match_score > 60", "piece"),
    ]
    piece = text.city_piece if true_city else text.third_last_piece
    return _flag(_with_parts(results, piece), results.columns, rules)


def audit_revised(results: DataFrame) -> DataFrame:
    """Add ``problems`` by the revised rule set: each match type has rules of its own."""
    suspect = f"match_type = 'FullAddress' AND {SAME_HOUSE} AND {OTHER_STREET} AND match_score > 80"
    short_a, short_b = (text.replace_all(f"upper(street_{s})", text.AUDIT_ABBREVIATIONS) for s in "ab")
    # Only suspects reach the kernel; two equal streets have ratio 100.
    rated = _with_parts(results).select("*", scorers.ratio(f"IF({suspect}, {short_a}, NULL)", short_b).alias("_streets"))
    names = f"{_unrelated('first')} AND {_unrelated('last')}"
    rules = [
        ("completely_diff_names", f"match_type = 'FullName' AND match_score > 80 AND {names}", "name"),
        ("diff_streets_same_house", "_streets <= 85", "street"),
        ("diff_property_types", f"match_type = 'FullAddress' AND {OTHER_UNIT_TYPE} AND match_score > 20", "unit"),
        ("diff_last_names", f"match_type = 'LastNameAddress' AND match_score > 80 AND {_unrelated('last')}", "last"),
    ]
    return _flag(rated, results.columns, rules)


def findings(flagged: DataFrame) -> DataFrame:
    """One row per problem of a flagged result."""
    return flagged.selectExpr(
        "match_type", "match_score AS score", "a_row", "b_row", "inline(problems) AS (problem, part_a, part_b)"
    ).select("match_type", "problem", "score", "a_row", "b_row", "part_a", "part_b")


def audit_summary(flagged: DataFrame, types=None) -> DataFrame:
    """Matches, findings and success rate per match type; the rate counts findings, not rows."""
    counts = flagged.groupBy("match_type").agg(F.expr("count(*) AS m"), F.expr("sum(size(problems)) AS p"))
    return (
        every_type(flagged, types)
        .join(counts, "match_type", "left")
        .selectExpr(
            "match_type",
            "coalesce(m, 0L) AS matches",
            "coalesce(p, 0L) AS problems",
            "IF(m > 0, round(100D * (m - p) / m, 1), 0D) AS success_rate",
        )
    )


def problem_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("match_type", "problem").agg(F.expr("count(*) AS cases"))


def problem_samples(found: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` findings per match type and problem, best scores first."""
    place = "row_number() OVER (PARTITION BY match_type, problem ORDER BY score DESC, a_row) AS place"
    return found.selectExpr("*", place).where(f"place <= {int(n)}")
