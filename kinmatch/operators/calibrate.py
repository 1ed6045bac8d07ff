"""Threshold calibration and expectation checks on labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a pair's score is expected to be, as (operator, bound).
EXPECTATIONS = {
    "FIXED": ("<=", 65.0),
    "PRESERVE": (">=", 85.0),
    "DIFFERENT": ("<=", 70.0),
    "LOW": ("<=", 60.0),
    "HIGH": (">=", 85.0),
}


def calibrate_threshold(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Halfway between the lowest GOOD and the highest BAD score; null if either is missing."""
    ends = pairs.agg(
        F.expr(f"min({score}) FILTER (WHERE {label} = 'GOOD') AS min_good"),
        F.expr(f"max({score}) FILTER (WHERE {label} = 'BAD') AS max_bad"),
    )
    return ends.selectExpr("min_good", "max_bad", "(min_good + max_bad) / 2 AS suggested")


def with_verdict(pairs: DataFrame, score: str = "score", label: str = "label", rules=None) -> DataFrame:
    """Add ``passed``; null for a label without a rule."""
    cases = " ".join(
        f"WHEN '{name}' THEN {score} {operator} {bound}D" for name, (operator, bound) in (rules or EXPECTATIONS).items()
    )
    return pairs.selectExpr("*", f"CASE {label} {cases} END AS passed")


def check_expectations(pairs: DataFrame, score: str = "score", label: str = "label", rules=None) -> DataFrame:
    """Passed and failed pairs per label."""
    checked = with_verdict(pairs.selectExpr(f"{label} AS label", f"{score} AS score"), rules=rules)
    return checked.groupBy("label").agg(
        F.expr("count_if(passed) AS passed"), F.expr("count_if(NOT passed) AS failed")
    )
