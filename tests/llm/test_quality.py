"""Quality scores: held-out accuracy, planted junk, defined cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm.quality import fit_pairs, keep_good, score_documents

DIR = "/root/testdata/sf0.01"


def test_pairs_recover_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    label = x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.1 > 0
    w = fit_pairs(x[label], x[~label])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.2 * w[0]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = score_documents(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    right = [(r.predicted == r.quality) for r in rows]
    assert len(rows) > 60 and sum(right) / len(right) > 0.97
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    ids = {r.doc_id: r.held_out for r in got.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held in ids.items())


def test_defined_cases(spark, documents):
    prose = "The river ran slowly past {} old houses, and people of the town walked along it every {} evening."
    junk = "buy now!! WIN WIN WIN %%% | {0} | {1} | $$$ "
    rows = [(i, (prose if i % 3 else junk * 4).format(i, f"w{i}x")) for i in range(90)] + [(90, None), (91, ""), (92, "  \n "), (None, "text"), (93, "long " * 200_000)]
    docs = documents(*rows).withColumn("_x", F.lit("clash")).withColumn("label", F.lit(7))
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 60)] + [(60, None, 0), (61, 5, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert len(got) == 95 and all(r.score is not None for r in got.values())
    assert all(got[i].predicted == (1 if i % 3 else 0) for i in range(60, 90))
    assert got[90].score == got[91].score == got[92].score and got[None].held_out is False
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(90) if i % 3}
    none = score_documents(docs, labels.limit(0))
    assert none.where("score <> 1.0 or predicted <> 1").count() == 0
    assert score_documents(docs.limit(0), labels).count() == 0
