"""Repeated passages: suffix arrays and removal against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import suffix_dedup
from kinmatch.llm.suffix_arrays import repeats_earlier, suffix_array
from kinmatch.llm.suffix_dedup import without_repeats

DIR = "/root/testdata/sf0.01"


def by_hand(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_arrays():
    rng = random.Random(1)
    for trial in range(300):
        text = [rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randrange(150))]
        if trial % 3 == 0:
            text = text[: rng.randrange(1, 8)] * 20
        array = np.array(text, np.int64)
        assert suffix_array(array).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        length, seen = rng.choice([1, 3, 10, 100]), set()
        found = repeats_earlier(array, length)
        for i in range(len(text) - length + 1):
            window = tuple(text[i : i + length])
            assert found[i] == (window in seen)
            seen.add(window)


@pytest.mark.parametrize("most", [2000, 3])
def test_removal(spark, documents, most):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, copy = text(60), text(80)
    rows = [(i, f"{text(rng.randrange(40))} {passage} {text(rng.randrange(40))}") for i in range(20)]
    rows += [(30 + i, copy) for i in range(5)] + [(40 + i, copy[: 200 + i] + "X" + copy[200 + i :]) for i in range(6)]
    rows += [(50, "ab " * 3000), (51, "ab " * 100 + "ba " * 100), (52, None), (53, ""), (54, "short"), (-3, passage), (None, copy[50:]), (55, passage[:99]), (56, passage[:100]), (57, (text(30) + " ") * 3)]
    df = documents(*rows).withColumn("tie", F.lit("x")).withColumn("start", F.lit(1))
    assert result(without_repeats(df.repartition(5), most=most)) == by_hand(rows)


def test_empty_table_and_repeated_rows(spark, documents):
    df = documents((1, "x" * 150), (1, "x" * 150))
    assert {r.n_removed for r in without_repeats(df).collect()} == {149} and without_repeats(df).count() == 2
    assert without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2000, 1])
def test_repeated_rows_that_share_a_passage(documents, most):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(300)
    rows = [(i, text(150) + passage + text(150)) for i in range(6)] + [(9, text(400))]
    df = documents(*rows, rows[0], rows[0], rows[3], rows[6]).repartition(3)
    got, expected = without_repeats(df, most=most), by_hand(rows)
    assert result(got) == expected and got.count() == len(rows) + 4
    assert {r.n_removed for r in got.where("doc_id = 0").collect()} == {0}


def test_a_common_phrase_is_not_dealt_out_window_by_window(documents, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, around = text(64), text(60)
    rows = [(i, text(200) + phrase + text(200)) for i in range(30)]
    rows += [(40 + i, text(150) + around + phrase + text(100)) for i in range(2)] + [(50, rows[3][1][120:330])]

    def by_window(several):
        raise AssertionError("no longer anchor has that many stretches")

    monkeypatch.setattr(suffix_dedup, "_by_window", by_window)
    got = result(without_repeats(documents(*rows).repartition(3), most=3))
    assert got == by_hand(rows) and got[41][1] > 0 and got[50][1] == 210


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = without_repeats(docs)
    assert result(got) == by_hand([tuple(r) for r in docs.collect()])
