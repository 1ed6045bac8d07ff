"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their
columns; the last returns the pieces of the packed sequences. Texts change in one
stage only: secrets are replaced by a mark, and n_chars, where there is such a
column, follows.

Defined cases: as in the operators' modules. Null texts count as empty; a
document without text is kept like any other, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import checkpoint, table
from kinmatch.llm.exact_dedup import distinct_documents
from kinmatch.llm.near_dedup import one_of_each
from kinmatch.llm.packing import pack
from kinmatch.llm.quality import keep_good
from kinmatch.llm.queries import public_tokenizer
from kinmatch.llm.secrets import redacted, secret_spans

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    found = secret_spans(docs.select(row, F.col("text")))
    clean = F.when(F.size("_all") > 0, redacted(F.col("_text"), F.col("_all"))).otherwise(F.col("_doc.text"))
    doc = F.col("_doc").withField("text", clean)
    if "n_chars" in docs.columns:
        same = F.col("_doc.n_chars")
        doc = doc.withField("n_chars", F.when(F.size("_all") > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(same))
    return found.select(doc.alias("_doc")).select("_doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens with the sources in the proportions of the whole."""
    return pack(docs, public_tokenizer("word_bpe_49k.json"), length=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: A fitted classifier and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
