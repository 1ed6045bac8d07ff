"""Line dedup against a plain-Python version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinmatch.llm.line_dedup import drop_repeated_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def by_hand(rows, least_length=10, least_docs=2):
    last = float("inf")
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        i_ = last if i is None else i
        gone = [len(key(x)) >= least_length and len(holders[key(x)]) >= least_docs and min(holders[key(x)]) != i_ for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def run(docs, **options):
    found = drop_repeated_lines(docs, **options)
    return sorted(map(tuple, found.select("_doc.doc_id", "_n_lines", "_n_dropped", "_kept").collect()), key=repr)


def test_random_texts(spark, documents):
    rnd = random.Random(5)
    pool = [f"line number {i} of the pool" for i in range(15)] + ["short", "", "  ", "Été à Paris là", "x" * 9, "y" * 10]

    def line():
        x = rnd.choice(pool)
        return rnd.choice(["", " ", "\t", "\r", "\x0b \x0c"]) + rnd.choice([x, x.upper(), x]) + rnd.choice(["", "  ", "\r"])

    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 12)))) for i in rnd.sample(range(10_000), 150)]
    docs = documents(*rows)
    assert run(docs) == by_hand(rows)
    assert run(docs.repartition(7), least_length=3, least_docs=5) == by_hand(rows, 3, 5)


def test_defined_cases(spark):
    schema = "doc_id long, text string, _id string, _line int, `a.b` int"
    shared, long_ = "a line that many share", "\n".join(f"line {i % 400} of a very long text" for i in range(60_000))
    rows = [(3, None), (4, ""), (7, shared), (7, shared), (7, shared + "\n\nother words here"), (9, " A LINE that many share\t\n"), (None, shared), (None, "other words here\nmine alone it is"), (11, long_), (12, long_ + "\nand some more"), (13, " a line that many share"), (2, "\n\n\n")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], schema)
    expected = by_hand(rows)
    assert run(docs) == expected
    found = {r[0]: r for r in expected}
    assert found[12][2] == 60_000 and found[12][3] == "and some more" and found[9][3] == "" and found[13][2] == 0
    assert drop_repeated_lines(docs).select("_doc.*").columns == docs.columns
    assert run(docs.limit(0)) == []
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r[1:] for r in run(nothing)} == {(1, 0, "")}


@pytest.mark.parametrize("copies", [3000])
def test_common_line(spark, copies):
    docs = spark.range(copies).selectExpr("id AS doc_id", "concat('the very same line\n', 'own line of ', id, '\nTHE very same line') AS text")
    found = run(docs)
    assert sum(r[2] for r in found) == 2 * (copies - 1)
    assert found[0][2] == 0 and found[0][3].count("\n") == 2


def test_no_python_in_the_plan(spark, documents):
    plan = drop_repeated_lines(documents((1, "a"), (2, "b")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_text_is_not_split_for_each_line(spark, documents):
    plan = drop_repeated_lines(documents((1, "a line that repeats"), (2, "a line that repeats\nb")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(" in plan and "lambdafunction(split" not in plan
