"""TF-IDF cosine similarity of pairs of strings, fitted on each pair alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CosineConfig:
    """How strings become n-grams and n-grams become weights."""

    name: str
    analyzer: str  # "char" or "word"
    smallest: int
    largest: int
    max_features: int | None = None
    sublinear: bool = False


ADDRESS = CosineConfig("address", "char", 2, 4, 1000)
NAME = CosineConfig("name", "word", 1, 2)
# The four configurations that are compared.
GRID = (
    CosineConfig("v1", "char", 2, 4, 1000),
    CosineConfig("v2", "char", 2, 5, 2000),
    CosineConfig("v3", "char", 3, 4, 1500),
    CosineConfig("v4", "char", 2, 3, 1000, True),
)


def _grams(c: str, config: CosineConfig) -> str:
    """SQL expression for the n-grams of a string."""
    if config.analyzer == "char":
        flat = rf"regexp_replace(lower({c}), r'(?U)\s\s+', ' ')"
        sizes = (
            f"IF(length({flat}) >= {n}, transform(sequence(1, length({flat}) - {n - 1}), i -> substr({flat}, i, {n})), array())"
            for n in range(config.smallest, config.largest + 1)
        )
    else:
        words = rf"regexp_extract_all(lower({c}), r'(?U)(\b\w\w+\b)', 1)"
        sizes = (
            f"IF(size({words}) >= {n}, transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')), array())"
            for n in range(config.smallest, config.largest + 1)
        )
    return f"concat({', '.join(sizes)})"


def cosine_scores(pairs: DataFrame, key: str, a: str, b: str, configs=(ADDRESS,)) -> DataFrame:
    """Score of every pair under every configuration: (key, config, cosine) from 0 to 100.

    Only the strings are shuffled, by ``key``; their n-grams are made after that,
    so both aggregations find their rows in place.  Pairs with an empty string,
    or without any n-gram, score 0.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs.selectExpr(f"`{key}`", f"`{a}` AS _a", f"`{b}` AS _b").repartition(tasks, key)
    usable = "_a <> '' AND _b <> ''"
    sided = {
        c.name: "concat("
        + ", ".join(f"transform({_grams(f'_{s}', c)}, g -> struct(g AS gram, '{s}' AS side))" for s in "ab")
        + ")"
        for c in configs
    }
    entries = ", ".join(f"struct('{n}' AS config, IF({usable}, {g}, array()) AS grams)" for n, g in sided.items())
    by_config = placed.selectExpr(f"`{key}`", f"inline(array({entries}))")
    grams = by_config.selectExpr(f"`{key}`", "config", "inline_outer(grams)")
    counts = grams.groupBy(key, "config", "gram").agg(
        F.expr("count_if(side = 'a') AS n_a"), F.expr("count_if(side = 'b') AS n_b")
    )
    counts = _limit_features(counts, key, configs)
    # With two documents a gram is in one of them or in both.
    idf = "IF(n_a > 0 AND n_b > 0, 1D, ln(1.5D) + 1)"
    sublinear = ", ".join(f"'{c.name}'" for c in configs if c.sublinear) or "''"

    def weight(n: str) -> str:
        return f"CASE WHEN {n} = 0 THEN 0D WHEN config IN ({sublinear}) THEN (1 + ln({n})) * {idf} ELSE {n} * {idf} END"

    weights = counts.selectExpr(f"`{key}`", "config", f"{weight('n_a')} AS w_a", f"{weight('n_b')} AS w_b")
    sums = weights.groupBy(key, "config").agg(
        F.expr("sum(w_a * w_b) AS dot"), F.expr("sqrt(sum(w_a * w_a)) * sqrt(sum(w_b * w_b)) AS norm")
    )
    return sums.selectExpr(f"`{key}`", "config", "bround(IF(norm > 0, 100D * dot / norm, 0D), 2) AS cosine")


def _limit_features(counts: DataFrame, key: str, configs) -> DataFrame:
    """Keep the most frequent grams of a pair where a configuration limits them."""
    limits = " ".join(f"WHEN '{c.name}' THEN {c.max_features}" for c in configs if c.max_features)
    if not limits:
        return counts
    place = f"row_number() OVER (PARTITION BY `{key}`, config ORDER BY n_a + n_b DESC, gram) AS _place"
    kept = f"_place <= coalesce(CASE config {limits} END, _place)"
    return counts.selectExpr("*", place).where(kept).drop("_place")
