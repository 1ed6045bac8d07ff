import pytest
from helpers import rows

from kinmatch.operators import audit, calibrate, coverage
from kinmatch.operators.compare import diff_summary, diff_tables
from kinmatch.operators.match import candidates, match

RESULT = "match_type string, match_score double, a_row long, b_row long, name_a string, name_b string, address_a string, address_b string"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        [
            ("FullName", 90.0, 2, 2, "ANN LEE", "BOB RAY", "1 A ST, X, CT 1", "1 B ST, X, CT 1"),
            ("FullName", 85.0, 3, 4, "ANN LEE", "ANNE LEE", "1 A ST, X, CT 1", "90 A ST, X, CT 1"),
            ("FullAddress", 95.0, 2, 2, "ANN LEE", "", "1 MAIN ROAD, X, CT 1", "1 MAIN RD, X, CT 1"),
            ("FullAddress", 82.0, 4, 2, "A B", "A B", "7 OAK LOT 3, X, CT 1", "7 ELMWOOD TRLR 3, X, CT 1"),
            ("FullAddress", 100.0, 5, 2, "A B", "A B", "0 OAK, X, CT 1", "0 ELM, X, CT 1"),
        ],
        RESULT,
    )


def test_first_audit(results):
    got = rows(audit.findings(audit.audit_first(results)), "match_type", "problem", "a_row")
    assert got == [
        ("FullAddress", "diff_cities", 2),
        ("FullAddress", "diff_cities", 4),
        ("FullAddress", "diff_cities", 5),
        ("FullAddress", "diff_property_types", 4),
        ("FullAddress", "same_house_diff_street", 2),
        ("FullAddress", "same_house_diff_street", 4),
        ("FullName", "diff_cities", 2),
        ("FullName", "diff_cities", 3),
        ("FullName", "diff_house_numbers", 3),
        ("FullName", "same_house_diff_street", 2),
    ]
    true_city = rows(audit.findings(audit.audit_first(results, true_city=True)).where("problem = 'diff_cities'"))
    assert true_city == []


def test_revised_audit(results):
    got = rows(audit.findings(audit.audit_revised(results)), "match_type", "problem", "a_row", "part_a")
    assert got == [
        ("FullAddress", "diff_property_types", 4, "LOT 3"),
        ("FullAddress", "diff_streets_same_house", 4, "OAK LOT 3"),
        ("FullName", "completely_diff_names", 2, "ANN LEE"),
    ]


def test_summaries(results):
    flagged = audit.audit_revised(results)
    assert rows(audit.audit_summary(flagged)) == [
        ("FullAddress", 3, 2, 33.3),
        ("FullName", 2, 1, 50.0),
        ("LastNameAddress", 0, 0, 0.0),
    ]
    first = {r.match_type: r.success_rate for r in audit.audit_summary(audit.audit_first(results)).collect()}
    assert first["FullAddress"] == -100.0  # findings are counted, not rows
    assert rows(audit.score_summary(results)) == [
        ("FullAddress", 3, 82.0, 100.0, 92.33),
        ("FullName", 2, 85.0, 90.0, 87.5),
        ("LastNameAddress", 0, None, None, None),
    ]
    levels = {(r.match_type, r.level): (r.matches, r.pct) for r in audit.score_distribution(results).collect()}
    assert levels["FullAddress", 95] == (2, 66.7) and levels["FullName", 90] == (1, 50.0)
    assert rows(coverage.below_perfect(results)) == [("FullAddress", 2), ("FullName", 2)]
    assert [r.a_row for r in coverage.lowest_matches(results, 2).collect()] == [4, 3]


def test_samples(results):
    found = audit.findings(audit.audit_first(results))
    got = audit.problem_samples(found, 1).where("problem = 'diff_cities'")
    assert rows(got, "match_type", "a_row", "score") == [("FullAddress", 5, 100.0), ("FullName", 2, 90.0)]


def test_coverage(results, people, spark):
    records = people(*[("A", "B", f"{i} C ST", "X", "CT", "1") for i in range(5)])
    got = {r.match_type: tuple(r)[1:] for r in coverage.coverage(records, results).collect()}
    assert got == {
        "FullName": (5, 2, 2, 3, 60.0),
        "LastNameAddress": (5, 0, 0, 5, 100.0),
        "FullAddress": (5, 3, 3, 2, 40.0),
        "ALL": (5, 5, 4, 1, 20.0),
    }
    none = {r.match_type: r.unmatched for r in coverage.coverage(records, results.where("false")).collect()}
    assert none == {"FullName": 5, "LastNameAddress": 5, "FullAddress": 5, "ALL": 5}
    raw = records.selectExpr("row_id", "First_Name AS anything", "Zip AS `odd name`")
    left = coverage.unmatched(raw, results)
    assert left.columns == ["Original_Row_Number", "anything", "odd name"]
    assert rows(left, "Original_Row_Number") == [(6,)]
    samples = rows(coverage.unmatched_samples(records, results, 2), "match_type", "a_row")
    assert samples == [("FullAddress", 3), ("FullAddress", 6), ("FullName", 4), ("FullName", 5), ("LastNameAddress", 2), ("LastNameAddress", 3)]


def test_sweep_is_not_a_filter(spark):
    # Candidate 2 is refined higher, but is let in only by the lower threshold's cutoff.
    scored = spark.createDataFrame(
        [("FullName", 1, 10, 90.0, 1, 86.0), ("FullName", 1, 20, 60.0, 2, 95.0)],
        "match_type string, a_id long, b_id long, stage1 double, rank int, score double",
    )
    best = coverage.at_thresholds(scored, {"FullName": [85.0, 70.0]})
    assert rows(best, "threshold", "b_id") == [(70.0, 20), (85.0, 10)]


def test_sweep_equals_separate_runs(people):
    a = people(("ANN", "LEE", "1 A ST", "X", "CT", "1"), ("BO", "RAY", "2 B ST", "X", "CT", "1"), ("ZED", "QUIN", "3 C RD", "Y", "NY", "2"))
    b = people(("ANNA", "LEES", "1 A ST", "X", "CT", "1"), ("BOB", "RAE", "2 D ST", "X", "CT", "1"), ("TED", "QUINN", "30 C RD", "Y", "NY", "2"))
    scored = candidates(a, b, thresholds=coverage.LOWER_THRESHOLDS)
    for r in coverage.threshold_sweep(scored).collect():
        assert r.at_current == match(a, b, r.match_type, r.current_threshold).count()
        assert r.at_lower == match(a, b, r.match_type, r.lower_threshold).count()
        assert r.gained == r.at_lower - r.at_current
    for r in coverage.gained_examples(scored).collect():
        assert r.match_score < {"FullName": 85, "LastNameAddress": 75, "FullAddress": 80}[r.match_type]


def test_calibration(spark):
    pairs = spark.createDataFrame([(77.78, "BAD"), (95.24, "GOOD"), (77.8, "GOOD"), (63.2, "BAD")], "score double, label string")
    got = calibrate.calibrate_threshold(pairs).first()
    assert (got.min_good, got.max_bad) == (77.8, 77.78) and got.suggested == pytest.approx(77.79)
    assert calibrate.calibrate_threshold(pairs.where("label = 'BAD'")).first().suggested is None


def test_expectations(spark):
    pairs = spark.createDataFrame(
        [(65.0, "FIXED"), (66.0, "FIXED"), (85.0, "PRESERVE"), (70.0, "DIFFERENT"), (61.0, "LOW"), (84.0, "HIGH")], "score double, label string"
    )
    assert rows(calibrate.check_expectations(pairs)) == [
        ("DIFFERENT", 1, 0),
        ("FIXED", 1, 1),
        ("HIGH", 0, 1),
        ("LOW", 0, 1),
        ("PRESERVE", 1, 0),
    ]


def test_diff(spark):
    schema = "row_id long, x string, y int"
    left = spark.createDataFrame([(0, "a", 1), (1, None, 2), (2, "c", 3)], schema)
    right = spark.createDataFrame([(0, "a", 1), (1, None, 5), (3, "d", 4)], schema)
    assert rows(diff_tables(left, right), "row_id", "side", "changed") == [
        (1, "both", "y"),
        (2, "left", "x,y"),
        (3, "right", "x,y"),
    ]
    assert tuple(diff_summary(left, right).first()) == (False, 3, 1)
    assert tuple(diff_summary(left, left).first()) == (True, 0, None)
    assert diff_summary(left, left.withColumn("z", left.y)).first().is_identical is False


def test_other_match_types_are_reported(people, spark):
    from kinmatch.operators.match import candidates, match
    from kinmatch.plans.specs import MatchSpec

    a = people(("PIA", "HOLLIS", "1 A ST", "X", "OH", "1"), ("OTTO", "KRAMER", "2 B ST", "X", "OH", "1"))
    b = people(("ANN", "HOLLIS", "9 C ST", "X", "OH", "1"))
    spec = MatchSpec("LastName", ("Last_Name",), ("last",), 80.0)
    results = match(a, b, spec)
    assert {r.match_type: r.matched for r in coverage.coverage(a, results).collect()} == {"FullAddress": 0, "FullName": 0, "LastName": 1, "LastNameAddress": 0, "ALL": 1}
    assert {r.match_type: r.matches for r in audit.score_summary(results).collect()}["LastName"] == 1
    assert {r.match_type: r.matches for r in audit.audit_summary(audit.audit_first(results)).collect()}["LastName"] == 1
    assert ("LastName", 3) in rows(coverage.unmatched_samples(a, results), "match_type", "a_row")
    scored = candidates(a, b, [spec])
    with pytest.raises(Exception, match="No thresholds for match type LastName"):
        coverage.threshold_sweep(scored).collect()
    both = {"LastName": 80.0}, {"LastName": 60.0}
    assert [r.at_current for r in coverage.threshold_sweep(scored, *both).collect()] == [1]


def test_names_with_quotes(people):
    from kinmatch.operators import coverage as reports
    from kinmatch.operators.match import match_all
    from kinmatch.plans.specs import MatchSpec

    a = people(("ANN", "LEE", "1 A ST", "X", "OH", "1"), ("BEA", "RAY", "2 B ST", "X", "OH", "1"))
    spec = MatchSpec("O'Neil \\ `x`", ("First_Name", "Last_Name"), ("first", "last", "address"), 80.0)
    results = match_all(a, a, [spec])
    assert rows(results, "match_type", "a_row") == [(spec.name, 2), (spec.name, 3)]
    told = {r.match_type: (r.results, r.matched) for r in reports.coverage(a, results.where("a_row = 2")).collect()}
    assert told[spec.name] == (1, 1) and told["ALL"] == (1, 1) and told["FullName"] == (0, 0)
    assert rows(reports.unmatched_samples(a, results.where("a_row = 2"), types=[spec.name]), "match_type", "a_row") == [(spec.name, 3)]
    assert rows(reports.row_counts(**{spec.name: a})) == [(spec.name, 2)]


def test_any_number_of_thresholds_equals_single_runs(spark):
    """The step function against one run per level, with equal scores, equal first stages and zeros."""
    import random

    from kinmatch.operators import coverage as reports
    from kinmatch.operators.match import best_of

    rnd = random.Random(3)
    data = []
    for kind in ("FullName", "FullAddress"):
        for a in range(60):
            stages = sorted((rnd.choice([40.0, 56.0, 64.0, 72.5, 80.0, rnd.uniform(30, 100)]) for _ in range(rnd.randint(0, 10))), reverse=True)
            data += [(kind, a, i * 7, s, i + 1, rnd.choice([0.0, 50.0, 70.0, 80.0, rnd.uniform(0, 100)])) for i, s in enumerate(stages)]
    scored = spark.createDataFrame(data, "match_type string, a_id int, b_id int, stage1 double, rank int, score double")
    levels = [0.0, *[2.0 * i for i in range(1, 50)], 70.0, 80.0]
    found = reports.at_thresholds(scored, {"FullName": levels, "FullAddress": levels[::-1]})
    assert found.columns == [*scored.columns, "threshold"]
    counts = {(r.match_type, r.threshold): r.matches for r in reports.matches_at(scored, {"FullName": levels, "FullAddress": levels}).collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r.threshold, set()).add((r.match_type, r.a_id, r.b_id, r.score))
    for t in set(levels):
        able = [r for r in data if r[3] >= 0.8 * t]
        best = {}
        for r in able:
            if r[5] > best.get(r[:2], (0, 0, 0, 0, 0, 0.0))[5]:
                best[r[:2]] = r
        expected = {(r[0], r[1], r[2], r[5]) for r in best.values() if r[5] >= t}
        assert got.get(t, set()) == expected, t
        for kind in ("FullName", "FullAddress"):
            assert counts[kind, t] == sum(x[0] == kind for x in expected)
    assert "Expand" not in reports.matches_at(scored, {"FullName": levels, "FullAddress": levels})._jdf.queryExecution().executedPlan().toString()
    assert best_of(scored.where("false"), "1").count() == 0


def test_diff_by_blocks(spark):
    """Digests change nothing: gaps, repeated and missing numbers, nulls, and only differing blocks are joined."""
    from kinmatch.operators import compare

    rows_ = [(i * 700, f"v{i}", None if i % 3 else i) for i in range(60)] + [(None, "n", 1), (5, "twice", 1), (5, "twice", 1)]
    other = [r for r in rows_ if r[0] != 1400]
    other = [(5, "TWICE", 1) if r[0] == 5 else (*r[:2], 9) if r[0] == 21000 else r for r in other] + [(10**12, "late", None)]
    a, b = (spark.createDataFrame(x, "row_id long, t string, n int") for x in (rows_, other))
    got = rows(compare.diff_tables(a, b), "row_id", "side", "changed")
    assert got == sorted([(1400, "left", "t"), (21000, "both", "n"), (10**12, "right", "t"), (None, "left", "n,t"), (None, "right", "n,t"), *[(5, "both", "t")] * 4], key=repr)
    blocks = {r[0] for r in compare.differing_blocks(a, b, ["t", "n"]).collect()}
    assert blocks == {None, 0, 21000 // compare.BLOCK, 10**12 // compare.BLOCK}
    whole = a.where("row_id is not null")
    assert compare.diff_tables(whole, whole.repartition(3)).count() == 0
    assert [tuple(r) for r in compare.diff_summary(whole, whole).collect()] == [(True, 0, None)]
