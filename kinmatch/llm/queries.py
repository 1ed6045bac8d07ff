"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import linked_ids
from .common import table
from .exact_dedup import exact_duplicates
from .fingerprints import edited_fingerprints
from .line_dedup import drop_repeated_lines
from .merkle import fold, leaf, manifest, proof, sha256_hex
from .near_dedup import near_duplicates
from .packing import pack
from .quality import score_documents
from .sampling import decode, sample_segmentations
from .secrets import count_of, joined, secret_spans
from .sharding import byte_shards
from .suffix_dedup import without_repeats
from .warc import archive_pages


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_segmentation_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizer("piece_bpe_32k.model")
    samples = sample_segmentations(table(spark, sf_dir, "documents"), model, k=2)
    told = decode(samples.withColumn("ids_crc32", F.crc32("ids")), model)
    return told.select(F.col("key").alias("doc_id"), "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "entropy")],
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_all").alias("spans"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), length=4096, end_id=2)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "class_id", "class_size", "kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start_byte")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_length=10, least_docs=2)
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    n_chars = F.when(hit, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    tampered = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    found = manifest(table(spark, sf_dir, "documents"), arity=2, keep={"tampered": tampered})
    folded = found.select("doc_id", "leaf", "subroot", "root", sha256_hex(proof(F.col("path"))).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_ids(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_segmentation_sampling, op2_quality, op3_secret_scan, op4_exact_dedup, op5_suffix_dedup, op6_packing, op7_near_dedup, op8_fingerprints, op9_warc, op10_sharding, op11_line_dedup, op12_merkle_manifest, op13_token_alignment)}
