"""Near duplicates: signatures estimate likeness, classes equal brute force."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import near_dedup
from kinmatch.llm.hashing import shingle_hashes, text_bytes, word_hashes
from kinmatch.llm.near_dedup import common_units, components, dart_signatures, near_duplicates, one_of_each, weighted_units

DIR = "/root/testdata/sf0.01"


def weighted_set(text, size=5):
    words = "".join(c if c not in "\t\n\r\x0b\x0c" else " " for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def classes_by_hand(rows, threshold=0.8):
    sets = [(i, weighted_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            having[x].add(n)
    pairs = {(a, b) for group in having.values() for a in group for b in group if a < b}
    for a, b in pairs:
        sa, sb = sets[a][1], sets[b][1]
        if sum((sa & sb).values()) >= threshold * sum((sa | sb).values()):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for n, (i, _) in enumerate(sets):
        low[root(n)] = min(low.get(root(n), i), i)
    return {i: low[root(n)] for n, (i, _) in enumerate(sets)}


def signatures(texts, k):
    import pyarrow as pa

    hashes, row = shingle_hashes(*word_hashes(*text_bytes(pa.array(texts))), 5)
    units, row = weighted_units(hashes, row)
    return dart_signatures(units, row, len(texts), k)


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["a b c d e f", "", " a  b\tc\nd e f ", "a b c", "b c d e f", "a b c d e f", "é é é é é é"]
    words, counts = word_hashes(*text_bytes(pa.array(["skip", *texts]).slice(1)))
    assert counts.tolist() == [6, 0, 6, 3, 5, 6, 6]
    hashes, row = shingle_hashes(words, counts, 5)
    by = [hashes[row == i].tolist() for i in range(len(texts))]
    assert by[0] == by[2] == by[5] and len(by[0]) == 2 and by[0][1] == by[4][0]
    assert len(by[1]) == 1 and len(by[3]) == 1 and by[6][0] == by[6][1] and by[3][0] != by[0][0]


def test_signatures_estimate_weighted_likeness():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:200] + [rng.choice(vocabulary) for _ in range(100)]), " ".join(base * 2), "one", " ".join(base[:150])]
    sig = signatures(texts, 2048)
    for i in range(len(texts)):
        for j in range(i):
            a, b = weighted_set(texts[i]), weighted_set(texts[j])
            true = sum((a & b).values()) / sum((a | b).values())
            assert abs((sig[i] == sig[j]).mean() - true) < 0.05


def test_common_units():
    a, b = np.array([1, 2, 2, 5], np.uint32), np.array([2, 2, 2, 5, 9], np.uint32)
    assert common_units(a, b) == 3 and common_units(np.array([1], np.uint32), np.array([2], np.uint32)) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (9, 8), (8, 7), (7, 6), (6, 9), (3, 3)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6} | {100 + i: 100 for i in range(41)} | {1000: 1000} | {2000 + i: 1000 for i in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    """No round is run on edges that are stars around their smallest nodes, and none to see that nothing changes."""
    written, plain = [], near_dedup.checkpoint
    monkeypatch.setattr(near_dedup, "checkpoint", lambda df: written.append(1) or plain(df))
    stars = [(10 * i, 10 * i + j) for i in range(20) for j in range(1, 10)]
    found = components(spark.createDataFrame(stars + stars[:5], "a long, b long").repartition(40))
    assert len(written) == 1 and found.count() == 200
    assert found.rdd.getNumPartitions() < 40 + spark.sparkContext.defaultParallelism
    written.clear()
    assert components(spark.createDataFrame([(9, 1), (9, 2)], "a long, b long")).where("root = 1").count() == 3
    assert len(written) == 2


@pytest.mark.parametrize("block,cut", [(8 << 20, True), (3000, False)])
def test_classes_equal_brute_force(spark, documents, monkeypatch, block, cut):
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            edited = [word() if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((n, " ".join(edited + (passage if rng.random() < 0.3 else [])) ))
            n += 1
    chain = [word() for _ in range(100)]
    for _ in range(30):  # each a step from the one before
        chain = chain[1:] + [word()]
        chain[rng.randrange(100)] = word()
        rows.append((n, " ".join(chain)))
        n += 1
    base = [word() for _ in range(120)]
    for _ in range(60):  # edited more or less, so alike or not
        edited = base[:]
        for i in rng.sample(range(120), rng.randrange(9)):
            edited[i] = word()
        rows.append((n, " ".join(edited)))
        n += 1
    rows += [(n, None), (n + 1, " \n"), (n + 2, ""), (n + 3, rows[0][1].upper()), (n + 4, "tok " * 30_000), (n + 5, "tok " * 29_000)]
    df = documents(*rows).withColumn("bands", F.lit(1)).withColumn("node", F.lit("x"))
    got = near_duplicates(df, cut=cut).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_hand(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got)
    assert Counter(r.class_id for r in got if r.kept) == Counter(set(sizes))
    kept = one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(sizes)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == classes_by_hand([tuple(r) for r in docs.collect()])
