"""Quality scores learned from preference pairs (Bradley-Terry).

Of two labelled documents the one with label 1 is preferred. The chance that i beats j is
sigmoid(w * (x_i - x_j)), so w is fitted by logistic loss on differences of
features. The threshold is a quantile of the raw scores of all labelled
training rows: the share of label 0 among them. Scores go to 0..1 by a logistic
curve that has its `cut` at the threshold.

Features come from the text alone and are SQL expressions, so all documents are scored
in one pass. At most `fit_rows` labelled rows of each label, drawn by a hash of
their id, are taken to the driver for the fit; that bound is the only one.

Defined cases: null text is empty; a text without words has the features of an empty
one and is scored like any other; labels other than 0 and 1 are ignored; where
either label has no row, no preference is known and every score is 1; repeated
rows are scored each; other columns of the input, whatever their names, are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, whole_text

FIT_ROWS = 20_000
PAIRS_PER_ROW = 8
CUT = 0.7
RIDGE = 1e-3

FEATURES = ("symbols", "bars", "shouts", "capitals", "digits", "variety", "echo", "word_size", "words", "lines", "marks")


def text_features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and _x, an array of numbers from 0 to about 1, in the order of FEATURES."""
    text = F.col("_t")
    rows = docs.select(*keep, whole_text(text_col).alias("_t"))
    blank = F.trim(F.regexp_replace(text, r"\s+", " "))
    rows = rows.withColumn("_words", F.filter(F.split(blank, " "), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    words, lines = F.col("_words"), F.col("_lines")
    rows = rows.withColumn("_n", F.greatest(F.size(words), F.lit(1)).cast("double")).withColumn("_chars", F.greatest(F.length(blank), F.lit(1)).cast("double"))
    n, chars = F.col("_n"), F.col("_chars")
    share = lambda pattern, of: F.sqrt(F.least(F.lit(1.0), F.regexp_count(text, F.lit(pattern)) / of))
    echo = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    x = F.array(
        share(r"[#$%&*+<>=@^~\\]", n),
        share(r"[|{}\[\]_]", n),
        share(r"[!?]", n),
        share(r"\p{Lu}", chars),
        share("[0-9]", chars),
        # Distinct words fall behind the number of words as a text grows; the ratio of logarithms hardly does.
        F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n),
        F.sqrt(echo / n),
        F.log1p(chars / n) / 4,
        F.log1p(n) / 12,
        F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        share("[.,;:]", n),
    )
    return rows.select(*keep, x.alias("_x"))


@dataclass(frozen=True)
class QualityModel:
    """Weights by feature, the raw threshold and the steepness of the curve; None without preferences."""

    weights: tuple[float, ...] | None
    threshold: float = 0.0
    steepness: float = 1.0
    cut: float = CUT

    def raw(self, x: str = "_x") -> Column:
        return sum((F.get(F.col(x), i) * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: str = "_x") -> Column:
        if self.weights is None:
            return F.lit(1.0)
        shift = float(np.log(self.cut / (1 - self.cut)))
        return 1 / (1 + F.exp(-((self.raw(x) - self.threshold) * self.steepness + shift)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, per_row: int = PAIRS_PER_ROW, seed: int = 1) -> np.ndarray:
    """Weights that maximise the likelihood of good over bad, by Newton steps."""
    rng = np.random.default_rng(seed)
    n = per_row * max(len(good), len(bad))
    order = lambda rows: rows[np.concatenate([rng.permutation(len(rows)) for _ in range(-(-n // len(rows)))])[:n]]
    d = order(good) - order(bad)
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ p / n - RIDGE * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, cut: float = CUT) -> QualityModel:
    """Fit on rows (doc_id, label, _x); all of them count for the threshold."""
    labelled = labelled.where("label in (0, 1)")
    drawn = []
    for label in (0, 1):
        rows = labelled.where(F.col("label") == label).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
        drawn.append(np.array([r["_x"] for r in rows.select("_x").collect()], np.float64))
    bad, good = drawn
    if not (len(bad) and len(good)):
        return QualityModel(None, cut=cut)
    weights = tuple(fit_pairs(good, bad).tolist())
    raw = labelled.select("label", QualityModel(weights).raw().alias("raw"))
    rate = raw.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    low, spread = raw.agg(F.percentile_approx("raw", F.lit(rate), F.lit(1_000_000)), F.stddev_pop("raw")).first()
    # The cut lies in the middle of the gap above the quantile.
    high = raw.where(F.col("raw") > low).agg(F.min("raw")).first()[0]
    threshold = low if high is None else (low + high) / 2
    return QualityModel(weights, threshold, 2 / (spread or 1.0), cut)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Labelled rows that aren't held out: doc_id, label, _x."""
    marks = labels.select(F.col("doc_id").alias("_labelled"), F.col(label_col).alias("label"))
    return features.where(~held_out()).join(marks, F.col("doc_id") == F.col("_labelled")).select("doc_id", "label", "_x")


def score_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    features = checkpoint(text_features(named, "text", ("doc_id",)))
    model = fit(training_rows(features, labels), fit_rows)
    scored = features.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that the classifier accepts, all columns as they are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    named = docs.select(row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    features = checkpoint(text_features(named, "text", ("doc_id",)))
    model = fit(training_rows(features, labels), fit_rows)
    # A filter on the score itself would be pushed below the features and repeat their expressions within each other.
    scored = text_features(named, "text", ("_doc",)).select("_doc", F.explode(F.array(model.score())).alias("_score"))
    return scored.where(F.col("_score") >= model.cut).select("_doc.*")
