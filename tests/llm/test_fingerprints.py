"""Fingerprints: exact edits and neighbours, estimates against true similarity."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import fingerprints as fp

DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def check(rows, got, tolerance):
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    errors = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (edited != text) or r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
        errors += [abs(r.near_edited - likeness(text, edited)), abs(r.near_next - likeness(text, after))]
    assert max(errors) < tolerance and sum(errors) / len(errors) < 0.03


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("bucket_rows", [1000, 7])
def test_given_documents(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", bucket_rows)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], fp.edited_fingerprints(docs).collect(), 0.25)


def test_defined_cases(spark, documents):
    rows = [(5, "one two"), (3, None), (2, " \n"), (9, "one two"), (-4, "long word list " * 20_000), (None, "last é words 👍 here of all")]
    df = documents(*rows).withColumn("_id", F.lit("x")).withColumn("fingerprint", F.lit(1))
    got = fp.edited_fingerprints(df).collect()
    check(rows, got, 0.3)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[5] == by[9] and by[3] == by[2] and len(by[5]) == fp.BINS * 2
    single = fp.edited_fingerprints(df.where("doc_id = 5")).collect()
    assert single[0].near_next == 1.0
    assert fp.edited_fingerprints(df.limit(0)).count() == 0
    assert fp.edited_fingerprints(documents((1, "a b"), (1, "c d"), (1, "c d"))).count() == 3
