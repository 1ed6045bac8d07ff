import random

import pytest
import textbook
from helpers import rows

from kinmatch.operators import similarity_join
from kinmatch.operators.match import by_score, candidates, match, match_all
from kinmatch.operators.near import near_matches
from kinmatch.operators.similarity_join import Grid, top_k_similar
from kinmatch.plans.specs import MatchSpec

TOWN = ("ELMFORD", "OH", "44901")
SOME = ("LOWFIELD", "OH", "44904")


@pytest.fixture(scope="module")
def tiny(people):
    a = people(("PIA", "HOLLIS", "771 CEDAR ST", *TOWN), ("OTTO", "KRAMER", "640 ASPEN LN", *SOME))
    b = people(
        ("PIA", "HOLLIS", "771 CEDAR ST", *TOWN),
        ("PIA", "HOLLYS", "773 CEDAR ST", *TOWN),
        ("RUBEN", "VANCE", "18 TANNER DR", *SOME),
        ("OTTO", "KRAMER", "640 ASPEN LN", *SOME),
        ("SELMA", "QUIST", "305 JUNIPER RD", "GREENPORT", "OH", "44903"),
    )
    return a, b


def test_one_result_per_input_row(tiny):
    got = rows(match(*tiny, "FullAddress", 70.0), "a_row", "b_row", "match_score")
    assert got == [(2, 2, 100.0), (3, 5, 100.0)]


def test_all_types(tiny):
    got = rows(by_score(match_all(*tiny)), "match_type", "a_row", "b_row")
    assert got == [(t, a, b) for t in ("FullAddress", "FullName", "LastNameAddress") for a, b in ((2, 2), (3, 5))]


def test_unknown_type(tiny):
    with pytest.raises(ValueError, match="Unknown match_type"):
        match(*tiny, "Nickname")


def test_new_type_is_data(tiny):
    spec = MatchSpec("LastName", ("Last_Name",), ("last",), 80.0)
    got = rows(match(*tiny, spec), "match_type", "a_row", "b_row", "match_score")
    assert got == [("LastName", 2, 2, 100.0), ("LastName", 3, 5, 100.0)]


def test_ties_go_to_the_lower_row(people):
    a = people(("ANN", "LEE", "1 A ST", *TOWN))
    b = people(("BOB", "RAY", "9 B ST", *SOME), *[("ANN", "LEE", "1 A ST", *TOWN)] * 30)
    for kind in ("FullName", "LastNameAddress", "FullAddress"):
        assert rows(match(a, b, kind), "b_row", "match_score") == [(3, 100.0)]
    assert candidates(a, b, ["FullName"]).count() == 10


def test_only_ten_slots(people):
    # Eleven rows tie in the first stage; the eleventh would have the better final score.
    a = people(("ANN", "LEE", "5 OAK ST", *TOWN))
    b = people(*[("ANN", "LEE", f"5{i} OAK ST", *TOWN) for i in range(10)], ("ANN", "LEE", "5 OAK ST", *TOWN))
    spec = MatchSpec("NameThenAddress", ("First_Name", "Last_Name"), ("address",), 10.0)
    got = rows(match(a, b, spec), "b_row", "match_score")
    assert got[0][0] != 12 and got[0][1] < 30


def test_zero_never_matches(people):
    a, b = people(("", "", "", "", "", "")), people(("ANN", "LEE", "5 OAK ST", *TOWN), ("", "", "", "", "", ""))
    assert match_all(a, b, thresholds={"FullName": 0.0, "LastNameAddress": 0.0, "FullAddress": 0.0}).count() == 0


def test_empty_tables(people, tiny):
    empty = tiny[0].where("false")
    assert match_all(empty, tiny[1]).count() == 0
    assert match_all(tiny[0], empty).count() == 0


def _crowd(spark, seed, n, extra="", copies=1):
    rnd = random.Random(seed)
    words = ["OAK", "ELM", "PINE", "ASH", "MAPLE", "ST,", "RD,", "CT", "NY", "LAKE"]
    data = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "S"]) for _ in range(rnd.randint(0, 4)))) for i in range(n)]
    data += [(n + i, "OAK ST, CT") for i in range(copies)]
    return spark.createDataFrame([("K", i, t) for i, t in data], "kind string, id long, search string"), data


def test_top_k_equals_brute_force_on_every_grid(spark):
    a, left = _crowd(spark, 1, 40, copies=20)
    b, right = _crowd(spark, 2, 150, copies=100)
    expected = []
    for i, x in left:
        scored = sorted((-textbook.token_set(x, y), j) for j, y in right)
        expected += [(i, j, round(-s, 9), r + 1) for r, (s, j) in enumerate([p for p in scored if -p[0] >= 50][:10])]
    for grid in (Grid(1, 1), Grid(3, 5)):
        got = top_k_similar(a.selectExpr("*", "50D AS cutoff"), b, 10, grid)
        assert sorted((r.a_id, r.b_id, round(r.stage1, 9), r.rank) for r in got.collect()) == sorted(expected)


def test_salted_keys_give_the_same(spark, monkeypatch):
    a, _ = _crowd(spark, 3, 30, copies=60)
    b, _ = _crowd(spark, 4, 80)
    a = a.selectExpr("*", "30D AS cutoff", "id * 2 AS twice")
    plain = rows(top_k_similar(a, b, 5, Grid(2, 2, 90)))
    monkeypatch.setattr(similarity_join, "HOT_KEY_ROWS", 7)
    assert rows(top_k_similar(a, b, 5, Grid(2, 2, 90))) == plain
    assert "twice" in top_k_similar(a, b, 5, Grid(1, 1, 90)).columns


def test_grid_is_bounded():
    grid = Grid.plan(1_000_000, 5_000_000_000, 4000)
    assert grid.left * similarity_join.LEFT_BLOCK >= 1_000_000
    assert grid.right * similarity_join.RIGHT_BLOCK >= 5_000_000_000
    assert grid.partitions(4000) <= 32 * 4000
    small = Grid.plan(1000, 15_000, 8)
    assert small.right == 1 and small.left == 10


def test_repartitioning_does_not_change_results(tiny):
    a, b = tiny
    assert rows(match_all(a.repartition(5), b.repartition(7))) == rows(match_all(a, b))


def test_no_cross_join_in_the_plan(tiny):
    plan = match_all(*tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_near_matches(people):
    far = ("1 BAY LN", "WINDHAM HILLS", "VT", "05001")
    a = people(("ANNA", "LEEDS", *far), ("PIA", "HOLLIS", "771 CEDAR ST", *TOWN))
    b = people(("ANNA", "LEEDS", *far), ("PI", "HOLLIS", "771 CEDAR ST", *TOWN), ("PIA", "HOLLIS", "77 LARCH RD", *SOME))
    got = near_matches(a, b, limit=2).collect()
    # Row 1 against master row 1: names near, full address equal.
    assert (got[0].a_row, got[0].b_row, got[0].match_type) == (3, 3, "FullName")
    assert 85 < got[0].score < 100
    by_tokens = near_matches(a, b, limit=2, weighted=False).collect()
    assert [(r.a_row, r.b_row, r.match_type) for r in by_tokens][0] == (3, 3, "FullName")
    assert near_matches(a, b, input_rows=1).count() == 0


def test_near_matches_by_rounds(people):
    """Hits far down the table, gaps in the row numbers, and as many as asked for."""
    a = people(*[("ZED", f"Q{i}", f"{i} Y ST", *TOWN) for i in range(150)], ("PIA", "HOLLIS", "771 CEDAR ST", *TOWN), ("RUBEN", "VANCE", "18 TANNER DR", *SOME))
    b = people(("PIA", "HOLLYS", "9 CEDAR ST", *SOME), ("RUBIN", "VANCE", "77 TANNER DR", *TOWN), ("RUBEN", "VANCES", "1 TAN DR", *TOWN))
    spread = a.selectExpr("row_id * 1000003 AS row_id", *a.columns[1:]) if a.columns[0] == "row_id" else a.withColumn("row_id", a.row_id * 1000003)
    for weighted in (True, False):
        whole = [(i, j, t) for i, x in enumerate(_strings(a)) for j, y in enumerate(_strings(b)) for t in ("FullName", "FullAddress", "LastNameAddress")
                 if 85 < (textbook.weighted if weighted else textbook.token_set)(x[t], y[t]) < 99.99]
        assert len(whole) >= 3
        for limit in (1, 2, 20):
            got = near_matches(a, b, limit=limit, weighted=weighted).collect()
            assert [(r.a_row - 2, r.b_row - 2, r.match_type) for r in got] == whole[:limit]
        got = near_matches(spread, b, limit=2, weighted=weighted).collect()
        assert [((r.a_row - 2) // 1000003, r.b_row - 2, r.match_type) for r in got] == whole[:2]
    assert near_matches(a.where("false"), b).count() == 0 and near_matches(a, b.where("false"), limit=3).count() == 0


def _strings(df):
    rows_ = sorted(df.collect(), key=lambda r: r.row_id)
    return [{"FullName": f"{r.First_Name} {r.Last_Name}", "FullAddress": r.FullAddress, "LastNameAddress": f"{r.Last_Name} {r.FullAddress}"} for r in rows_]


def test_long_strings_and_many_letters(spark):
    """Strings of 20,000 characters over a large alphabet, among short ones, in cells that hold few characters."""
    rnd = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    long_ = [" ".join(word(9) for _ in range(2000)) for _ in range(3)]
    short = [f"{word(3)} {word(4)}" for _ in range(60)]
    left = list(enumerate([long_[0], short[0], short[1], short[2][:-1], ""]))
    right = list(enumerate([*short, long_[0], long_[1], " ".join(long_[0].split()[5:]), ""]))
    a, b = (spark.createDataFrame([("K", i, t) for i, t in side], "kind string, id long, search string") for side in (left, right))
    got = top_k_similar(a.selectExpr("*", "80D AS cutoff"), b, 3).select("a_id", "b_id", "stage1").collect()
    found = {(r.a_id, r.b_id): r.stage1 for r in got}
    assert set(found) == {(0, 60), (0, 62), (1, 0), (2, 1), (3, 2)}
    assert found[0, 60] == found[0, 62] == found[1, 0] == 100 and found[3, 2] == textbook.token_set(left[3][1], right[2][1])


def test_blocks_hold_few_characters(spark):
    from kinmatch.operators.similarity_join import RIGHT_BLOCK, SHORT, Side, side_of

    strings = spark.range(1000).selectExpr("'K' AS kind", "id", "repeat('x', CAST(IF(id < 10, 20000, 30) AS INT)) AS search")
    side = side_of(strings, 1000, 20_000)
    assert side.rows == 1000 and side.classes[0] == 990 and side.classes[-1] == 10 and len(side.classes) == 8
    huge = Side(10**9, (0,) * 7 + (10**9,)).blocks(RIGHT_BLOCK)
    assert huge[7] * RIGHT_BLOCK * SHORT >= 10**9 * 20_000
    assert side_of(strings, 1000, 100).classes == ()
    grid = Grid.plan(side, Side(50), 8)
    used = strings.selectExpr(f"search AS token_key").selectExpr(f"{grid.block('left')} AS block", "length(token_key) AS n").groupBy("n").agg({"block": "max"}).collect()
    assert max(r[1] for r in used) < grid.left
