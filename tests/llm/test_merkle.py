"""Merkle manifest against a plain-Python tree."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinmatch.llm.merkle import fold, leaf, manifest, numbered, proof

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_by_hand(row):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    i, text, lang, source, n = row
    return sha("".join(map(one, (i, source, lang, n, text))))


def climb(nodes, arity):
    """The root, and per node its siblings (before, after) from the bottom up."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for j in range(len(run)):
                for x in below[a + j]:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            under.append([x for b in below[a : a + arity] for x in b])
        nodes, below = up, under
    return nodes[0], paths


def by_hand(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_by_hand(r), r[0]))
    names = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    told = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    root, upper = climb([told[g][0] for g in names], arity)
    out = []
    for g, up in zip(names, upper):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), told[g][1]):
            out.append((x[3], x[2], told[g][0], root, path + up))
    return sorted(out, key=repr)


def run(docs, **options):
    found = manifest(docs, COLUMNS, **options)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found.collect()), key=repr)


def table(spark, sizes, seed=1):
    rnd = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for i in rnd.sample(range(100_000), n):
            rows.append((i, rnd.choice(["", None, "some text", "mehr Wörter"]), lang, rnd.choice(["s", None]), rnd.choice([None, 5, -3])))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("arity,depth", [(2, 2), (2, 10), (3, 1), (5, 2)])
def test_trees_of_all_sizes(spark, arity, depth):
    rows, docs = table(spark, {None: 1, "": 2, "a": 3, "é": 17, "z": 64, "Z": 65, "en": 150})
    assert run(docs.repartition(6), arity=arity, depth=depth) == by_hand(rows, arity)


def test_defined_cases(spark):
    schema = SCHEMA + ", _group string, _hash int, `a.b` int"
    rows = [(None, None, None, None, None), (None, "x", None, "s", 1), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (4, "y", "en", "s", 1), (5, "w " * 100_000, "en", "", 0), (6, "1:a", "en", "-", 9)]
    docs = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], schema)
    assert run(docs) == by_hand(rows)
    assert run(docs.limit(0)) == []
    one = by_hand(rows[2:3])
    assert run(spark.createDataFrame(rows[2:3], SCHEMA)) == one and one[0][1] == one[0][2] == one[0][3] and one[0][4] == []


def test_folding_tells_changed_rows(spark):
    rows, docs = table(spark, {"a": 40, "b": 9})
    changed = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text")])
    found = manifest(docs, COLUMNS, depth=2, keep={"now": changed}).select("doc_id", "leaf", "root", "now", fold(F.col("now"), F.col("path")).alias("folded"), proof(F.col("path")).alias("proof")).collect()
    assert all((r.folded == r.root) == (r.now == r.leaf) for r in found)
    assert any(r.now != r.leaf for r in found)
    expected = {x[0]: "".join(b + a for b, a in x[4]) for x in by_hand(rows)}
    assert {r.doc_id: r.proof for r in found} == expected


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("IF(id % 3 = 0, 'x', concat('g', id % 5)) AS _group", "id AS _order", "sha2(string(id), 256) AS _hash")
    for parts in (1, 9):
        found = numbered(rows.repartition(parts), [F.col("_order").asc()]).collect()
        for g in {r._group for r in found}:
            mine = sorted((r for r in found if r._group == g), key=lambda r: r._order)
            assert [r._at for r in mine] == list(range(len(mine))) and {r._n for r in mine} == {len(mine)}


def test_no_python_in_the_plan(spark):
    plan = manifest(table(spark, {"a": 5})[1], COLUMNS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
