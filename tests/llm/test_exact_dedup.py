"""Exact duplicates: groups against brute force, at any size of the bit table."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinmatch.llm.exact_dedup import distinct_documents, exact_duplicates, may_repeat, table_bits

ROWS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (10, "alone")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("largest", [30, 4])
def test_groups(spark, documents, largest):
    df = documents(*ROWS, *[(100 + i, "copy") for i in range(50)], *[(200 + i, f"own {i}") for i in range(300)])
    df = df.withColumn("keep_id", F.lit("x")).withColumn("_slots", F.lit(1))
    groups = defaultdict(list)
    for r in df.collect():
        groups[lower(r.text)].append(r.doc_id)
    got = exact_duplicates(df, largest=largest).collect()
    want = {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == df.count()
    kept = distinct_documents(df, largest=largest)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())


def test_repeated_rows_and_nulls(spark, documents):
    df = documents((1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"))
    got = exact_duplicates(df).collect()
    assert sorted((str(r.keep_id), r.group_size) for r in got) == sorted([("1", 4)] * 4 + [("None", 2)] * 2)
    assert sum(r.kept for r in got) == 2
    assert sorted(str(r.doc_id) for r in distinct_documents(df).collect()) == ["1", "None"]
    assert exact_duplicates(df.limit(0)).count() == 0 and distinct_documents(df.limit(0)).count() == 0


def test_few_rows_pass_the_filter(spark, documents):
    df = documents(*[(i, f"text {i}") for i in range(2000)], (5000, "text 7")).select(F.col("text").alias("_text"))
    flagged = may_repeat(df, table_bits(2001)).where("_maybe").count()
    assert 2 <= flagged < 60
