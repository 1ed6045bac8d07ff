"""The pipeline's stages against brute force on the smallest tables."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark, tmp_path):
    from test_near_dedup import classes_by_hand

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, rows = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, DIR).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        rows[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    start = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = {r.doc_id for r in rows["quality"]}
    judged = [(r.doc_id in good) == (labels[r.doc_id] == 1) for r in start if r.doc_id in labels]
    assert sum(judged) / len(judged) > 0.95
    best = defaultdict(int)
    for r in rows["quality"]:
        best[lower(r.text)] = max(best[lower(r.text)], r.doc_id)
    assert {r.doc_id for r in rows["exact_dedup"]} == set(best.values())
    classes = classes_by_hand([(r.doc_id, r.text) for r in rows["exact_dedup"]])
    near = {r.doc_id for r in rows["near_dedup"]}
    assert len(near) == len(set(classes.values())) == len({classes[i] for i in near})
    before = {r.doc_id: r for r in rows["near_dedup"]}
    assert {r.doc_id for r in rows["secret_scan"]} == set(before)
    for r in rows["secret_scan"]:
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id].text or "[SECRET]" in r.text
    tokens = defaultdict(int)
    for r in rows["packing"]:
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(before) and all(tokens[r.doc_id] == r.doc_tokens for r in rows["packing"])
    again = cp.run(spark, DIR).agg(F.count("*"), F.sum("length")).first()
    assert tuple(again) == (len(rows["packing"]), sum(r.length for r in rows["packing"]))


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, node int"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", 1), (1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, "b", 2), (3, "token=abcdefgh", "en", "s", 14, None, None), (None, "words " * 50_000, "en", "s", 1, "", 3)], schema)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        empty = stage(spark, docs.limit(0), DIR)
        assert empty.count() == 0 and out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns and empty.schema.fieldNames() == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cp.secret_scan(spark, docs, DIR).collect()}
    assert texts[3] == ("[SECRET]", 8) and texts[1] == (None, None)
