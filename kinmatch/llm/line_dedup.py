"""Removal of lines that repeat across documents.

Texts are exploded into lines. The key of a line is the line without blanks at both ends and
with A-Z in lower case; keys of at least `least_length` code points are hashed by SHA-256, and the
distinct documents of each hash are counted. A hash found in `least_docs` documents or more
loses all its lines except those of the document with the smallest id that holds it. What goes is
gathered per document as line numbers, and the other lines are put together again by position.

Counting shuffles hashes and ids only, first by hash and id, so that the documents of a common line are
counted in many tasks, then one partial count per hash and task. The lines are matched with the
counted hashes by `lookup`, which serves common lines by broadcast.

Defined cases: null and empty texts are one empty line; rows of equal id are one document (their lines of one
key stay in all of them, or go from all of them); null ids are one document, after all others; a row is
found again by its id and the SHA-256 of its text, so that rows alike in both get equal results; an empty table gives no
rows; other columns are carried along and never read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, lookup, whole_text

#: The characters stripped from both ends of a line, space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

LEAST_LENGTH, LEAST_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def line_hashes(rows: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The lines of `rows` (_id, _digest, _text) whose key is long enough: _id, _digest, _at (line number from 0), _line (hash)."""
    lines = rows.select("_id", "_digest", F.posexplode(_lines(F.col("_text"))).alias("_at", "_raw"))
    keyed = lines.select("_id", "_digest", "_at", line_key(F.col("_raw")).alias("_key")).where(F.length("_key") >= least_length)
    return keyed.select("_id", "_digest", "_at", _digest(F.col("_key")).alias("_line"))


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Hashes found in `least_docs` documents or more: _line, _docs, _first (the smallest id)."""
    docs = F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))
    counted = lines.groupBy("_line").agg(docs.cast("long").alias("_docs"), F.min("_id").alias("_first"))
    return counted.where(F.col("_docs") >= least_docs)


def _without(lines: Column, gone: Column) -> Column:
    """The lines joined again without those numbered in `gone`, in linear time."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.array_join(F.transform(F.array_except(every, gone), lambda i: F.get(lines, i)), "\n")


def drop_repeated_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of `docs` as column _doc, with _n_lines (before), _n_dropped and _kept (the text that stays)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("_id"), whole_text(f"`{text_col}`").alias("_text"))
    rows = rows.select("_doc", "_id", "_text", _digest(F.col("_text")).alias("_digest"))
    lines = line_hashes(rows, least_length)
    repeated = checkpoint(repeated_lines(lines, least_docs))
    found = lookup(lines, repeated, "_line", "_docs")
    gone = found.where(F.col("_docs").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")))
    gone = gone.groupBy(F.col("_id").alias("_of_id"), F.col("_digest").alias("_of_digest")).agg(F.collect_set("_at").alias("_gone"))
    same = F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_digest") == F.col("_of_digest"))
    # Split once, in a column of its own: within the function of an array it would be split again for each line.
    marked = rows.join(gone, same, "left").select("_doc", "_text", "_gone", _lines(F.col("_text")).alias("_lines"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_without(F.col("_lines"), F.col("_gone")))
    return marked.select(
        "_doc",
        F.size("_lines").cast("long").alias("_n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_dropped"),
        text.alias("_kept"),
    )
