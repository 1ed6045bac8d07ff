"""Left keys whose best right keys are found by equi-joins alone.

A left key's *bar* is a score that ``k`` right rows are known to reach, so nothing below it matters.
It comes from right keys that share a rare token with the left key, or are equal to it.

Where the bar is high, few right keys can reach it, and each of them shares something rare with the left key:

* A score over the whole keys, 200 · m / (la + lb), takes 3 m + 1 - la - lb common two-letter grams: of the
  la + 1 grams of a key with one blank at either end, a character without partner breaks two, and one without
  partner in the other key breaks one.  Common grams are the same for any order of the tokens.
* A score over common tokens, 200 · s / (s + la) or 200 · s / (s + lb), takes s characters of common tokens.

With grams and tokens in order of rarity, the rarest common one stands so early that enough can follow it.  So only
these prefixes are joined: grams with grams, the left prefix of tokens with all right tokens, all left tokens with the
right prefix.  What they find is scored; a pair that they don't find is below the bar.

Keys with a low bar, and keys whose prefixes would meet too many right keys, are left to the grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scorers
from ..session import written


@dataclass(frozen=True)
class Closing:
    """When keys leave the grid; the result is the same for any values."""

    rare: int = 64  # a token of up to this many right keys gives bars
    bar: float = 90.0  # keys with a lower bar stay
    most: int = 20_000  # right keys that the prefixes of one key may meet

    def __post_init__(self):
        if not 70 <= self.bar <= 100:
            raise ValueError("Keys can be closed at bars from 70 to 100 only, as below no gram need be common")


SLACK = 1e-6
KEY = ["kind", "no"]


def _tokens(keys: DataFrame) -> DataFrame:
    return keys.selectExpr("*", "explode(filter(split(token_key, ' '), t -> t <> '')) AS token")


def _grams(keys: DataFrame) -> DataFrame:
    padded = "concat(' ', token_key, ' ')"
    grams = f"array_distinct(transform(sequence(1, length(token_key) + 1), i -> substring({padded}, i, 2)))"
    return keys.where("token_key <> ''").selectExpr("*", f"explode({grams}) AS gram")


def bars(left: DataFrame, right: DataFrame, k: int, closing: Closing) -> DataFrame:
    """``left`` (kind, token_key, cutoff, no) with ``bar``: the k-th best score found so far, or the cutoff.

    ``right`` has (kind, token_key, no, ids).
    """
    tokens = _tokens(right.selectExpr("kind", "token_key AS other", "token_key", "size(ids) AS n"))
    few = tokens.groupBy("kind", "token").agg(F.count("*").alias("keys")).where(f"keys <= {int(closing.rare)}")
    near = _tokens(left.select(*KEY, "token_key")).join(tokens.join(few, ["kind", "token"]).select("kind", "token", "other", "n"), ["kind", "token"])
    near = near.select(*KEY, "token_key", "other", "n").distinct()
    near = near.where("token_key <> other").select("*", scorers.token_set_ratio("token_key", "other").alias("score"))
    equal = left.where("token_key <> ''").join(right.selectExpr("kind", "token_key", "token_key AS other", "size(ids) AS n"), ["kind", "token_key"])
    scored = near.select(*KEY, "n", "score").unionByName(equal.selectExpr(*KEY, "n", "100D AS score"))
    reached = scored.selectExpr(*KEY, "score", "sum(n) OVER (PARTITION BY kind, no ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS so_far")
    found = reached.where(f"so_far >= {int(k)}").groupBy(*KEY).agg(F.max("score").alias("found"))
    # A little less, so that a tie at the bar is never lost to rounding.
    return left.join(found, KEY, "left").selectExpr(*left.columns, f"greatest(cutoff, coalesce(found - {SLACK}, cutoff)) AS bar")


def _shared(length: str, bar: str) -> str:
    """Characters of common tokens that a score of ``bar`` through one key's length takes."""
    return f"({bar} / (200 - {bar}) * {length} - {SLACK})"


def _with_rest(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Tokens with ``rest``: the characters of common tokens if this is the rarest one, at most."""
    placed = tokens.join(counts, ["kind", "token"], "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
    after = "PARTITION BY kind, no ORDER BY keys, token ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return placed.selectExpr("*", f"sum(length(token) + 1) OVER ({after}) - 1 AS rest")


def _gram_prefix(keys: DataFrame, counts: DataFrame, bar: str) -> DataFrame:
    """The rarest grams of each key, one of which any key of a score over ``bar`` on the whole must have."""
    # The other key is no shorter than this; with a longer one more grams are common.
    shortest = f"({bar} / (200 - {bar}) * length(token_key))"
    common = f"greatest(ceil((1.5D * {bar} / 100 - 1) * (length(token_key) + {shortest}) + 1 - {SLACK}), 1)"
    placed = _grams(keys).join(counts, ["kind", "gram"], "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
    place = "row_number() OVER (PARTITION BY kind, no ORDER BY keys, gram)"
    return placed.selectExpr("*", f"{place} AS place").where(f"place <= length(token_key) + 2 - {common}").drop("place", "keys")


def split_closed(left: DataFrame, right: DataFrame, k: int, closing: Closing) -> tuple[DataFrame, DataFrame]:
    """(rows left to the grid, pairs found): ``left`` with its bars as cutoffs, and (kind, token_key, ids, score).

    ``left`` has (kind, token_key, cutoff, no), ``right``, read several times, (kind, token_key, ids, no); ``no`` tells the keys of a kind apart.
    """
    # Bars of 200 and more would divide by zero below; no score is over 100 either way.
    left = written(bars(left, right, k, closing)).withColumn("bar", F.least("bar", F.lit(150.0)))
    high = left.where(f"bar >= {float(closing.bar)!r}D - {SLACK} AND token_key <> ''")
    slim = right.select(*KEY, "token_key")

    right_tokens = _tokens(slim)
    counts = right_tokens.groupBy("kind", "token").agg(F.count("*").alias("keys"))
    least = f"({float(closing.bar)!r}D - {SLACK})"
    right_prefix = written(_with_rest(right_tokens, counts).where(f"rest >= {_shared('length(token_key)', least)}").select(*KEY, "token_key", "token", "rest"))
    left_tokens = _with_rest(_tokens(high.select(*KEY, "token_key", "bar")), counts)
    left_tokens = written(left_tokens.selectExpr(*KEY, "token_key", "bar", "token", "keys", f"rest >= {_shared('length(token_key)', 'bar')} AS early"))
    gram_counts = _grams(slim).groupBy("kind", "gram").agg(F.count("*").alias("keys"))
    right_grams = written(_gram_prefix(slim, gram_counts, least))
    left_grams = written(_gram_prefix(high.select(*KEY, "token_key", "bar"), gram_counts, "bar"))

    # Right keys that each left key would meet, from counts alone.
    by_token = right_prefix.groupBy("kind", "token").agg(F.count("*").alias("meets"))
    by_gram = right_grams.groupBy("kind", "gram").agg(F.count("*").alias("meets"))
    meets = (
        left_tokens.where("early").selectExpr(*KEY, "keys AS meets")
        .unionByName(left_tokens.join(by_token, ["kind", "token"]).select(*KEY, "meets"))
        .unionByName(left_grams.join(by_gram, ["kind", "gram"]).select(*KEY, "meets"))
    )
    crowded = written(meets.groupBy(*KEY).agg(F.sum("meets").alias("meets")).where(f"meets > {int(closing.most)}").select(*KEY))
    left_tokens, left_grams = (x.join(crowded, KEY, "left_anti") for x in (left_tokens, left_grams))

    mine = ["kind", "no AS a_no", "token_key AS a_key", "bar"]
    other = ["kind", "no AS b_no", "token_key AS b_key"]
    length = "length(b_key) BETWEEN bar / (200 - bar) * length(a_key) - 1e-6 AND (200 - bar) / bar * length(a_key) + 1e-6"
    pairs = (
        left_tokens.where("early").selectExpr(*mine, "token").join(right_tokens.selectExpr(*other, "token"), ["kind", "token"]).drop("token")
        .unionByName(
            left_tokens.selectExpr(*mine, "token").join(right_prefix.selectExpr(*other, "token", "rest"), ["kind", "token"])
            .where(f"rest >= {_shared('length(b_key)', 'bar')}").drop("token", "rest")
        )
        .unionByName(left_grams.selectExpr(*mine, "gram").join(right_grams.selectExpr(*other, "gram"), ["kind", "gram"]).where(length).drop("gram"))
    ).dropDuplicates(["kind", "a_no", "b_no"])
    scored = pairs.select("kind", F.col("a_key").alias("token_key"), "b_no", "bar", scorers.token_set_ratio("a_key", "b_key").alias("score"))
    # Written, so that the filter below doesn't score once more.
    scored = written(scored).where("score >= bar").select("kind", "token_key", "b_no", "score")
    found = scored.join(right.select("kind", F.col("no").alias("b_no"), "ids"), ["kind", "b_no"]).select("kind", "token_key", "ids", "score")
    closed = high.select(*KEY).join(crowded, KEY, "left_anti")
    rest = left.join(closed, KEY, "left_anti").selectExpr("kind", "token_key", "bar AS cutoff")
    return rest, found
