"""Looking candidates up in the master: filter, salt and broadcast give the same rows."""

import pytest
from helpers import rows

from kinmatch.operators import match as match_module
from kinmatch.operators.lookup import filter_bits, look_up, only_wanted, salted_join
from kinmatch.operators.match import match_all

TOWN = ("ELMFORD", "OH", "44901")


def test_filter_keeps_all_wanted_and_little_else(spark):
    master = spark.range(200_000).selectExpr("id * 3 AS b_id", "concat('name ', id) AS name")
    wanted = spark.range(500).selectExpr("id * 999 AS b_id")
    passed = only_wanted(master, "b_id", wanted, filter_bits(500))
    assert passed.columns == master.columns
    assert passed.join(wanted, "b_id").count() == 500 and passed.count() < 20_000
    assert only_wanted(master, "b_id", wanted.where("false"), filter_bits(0)).count() == 0


def test_filter_is_bounded():
    assert filter_bits(0) == 1 << 15 and filter_bits(10**12) == 1 << 29
    assert filter_bits(1000) >= 16_000


def test_salted_join_equals_plain(spark):
    many = spark.range(900).selectExpr("id AS a_id", "IF(id % 3 = 0, 7, id % 50) AS b_id", "id % 2 AS x")
    few = spark.range(60).selectExpr("id AS b_id", "id * 10 AS y")
    plain = rows(many.join(few, "b_id").select("a_id", "b_id", "x", "y"))
    assert rows(salted_join(many, few, ["b_id"], "a_id", hot_rows=20).select("a_id", "b_id", "x", "y")) == plain
    assert rows(look_up(many, few, "b_id", "a_id", 900, hot_rows=20).select("a_id", "b_id", "x", "y")) == plain


@pytest.fixture(scope="module")
def sides(people):
    names = [("ANN", "LEE"), ("ANNA", "LEE"), ("BOB", "RAY"), ("ANN", "LEIGH"), ("ROB", "RAY")]
    a = people(*[(f, l, f"{i % 7} OAK ST", *TOWN) for i, (f, l) in enumerate(names * 8)])
    b = people(*[(f, l, f"{i % 9} OAK ST", *TOWN) for i, (l, f) in enumerate([(y, x) for x, y in names] * 12)])
    return a, b


def test_both_branches_give_the_same(sides, monkeypatch):
    plain = rows(match_all(*sides))
    monkeypatch.setattr(match_module, "BROADCAST_BYTES", 0)
    looked_up = match_all(*sides)
    assert rows(looked_up) == plain and plain


def test_plan_of_the_large_branch(sides, monkeypatch):
    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    assert "bitmap_construct_agg" not in plan(match_all(*sides))
    monkeypatch.setattr(match_module, "BROADCAST_BYTES", 0)
    told = plan(match_all(*sides))
    assert "bitmap_construct_agg" in told and "CartesianProduct" not in told and "NestedLoop" not in told
