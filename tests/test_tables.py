import pytest
from helpers import rows

from kinmatch.sources import tables


def test_csv_as_text(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes("﻿First_Name,Zip,,\r\nEllen,06301,, \r\n\"Zoë\",6301-1234,,\r\n".encode())
    df = tables.read_table(spark, str(path))
    assert df.columns[:2] == ["First_Name", "Zip"] and len(df.columns) == 4
    assert rows(df, "First_Name", "Zip") == [("Ellen", "06301"), ("Zoë", "6301-1234")]


def test_row_ids_follow_files(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("x\n" + "\n".join(f"a{i}" for i in range(3)) + "\n")
    (folder / "b.csv").write_text("x\n" + "\n".join(f"b{i:05d}" for i in range(4000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tables.with_row_id(tables.read_table(spark, str(folder)))
        got = [(r.row_id, r.x) for r in df.orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate([f"a{i}" for i in range(3)] + [f"b{i:05d}" for i in range(4000)]))


def test_row_ids_of_parquet(spark, tmp_path):
    spark.range(50).selectExpr("id AS x").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = tables.with_row_id(tables.read_table(spark, str(tmp_path / "p")))
    assert rows(got, "row_id", "x") == sorted(((i, i) for i in range(50)), key=repr)


@pytest.fixture()
def folder(spark, tmp_path):
    for name, n in (("First", 3), ("Second", 3), ("Third", 9), ("results_FullName", 1), ("Unmatched_Rows", 1), ("Match_Results", 1)):
        spark.range(n).selectExpr("id AS row_id", "CAST(id AS STRING) AS x").write.parquet(str(tmp_path / name))
    (tmp_path / "Extra.csv").write_text("row_id,x\n0,y\n")
    return str(tmp_path)


def test_table_sets(spark, folder):
    names = lambda **kw: list(tables.read_table_set(spark, folder, **kw))
    assert names() == ["Extra", "First", "Match_Results", "Second", "Third"]
    assert names(exclude=("Match_Results", "Extra")) == ["First", "Second", "Third"]
    assert names(exclude_prefixes=("results_",)) == ["Extra", "First", "Match_Results", "Second", "Third", "Unmatched_Rows"]
    assert names(only_prefix="results_") == ["results_FullName"]


def test_roles(spark, folder):
    found = tables.read_table_set(spark, folder, exclude=("Match_Results", "Extra"))
    assert tables.choose_roles(found) == ("First", "Second")  # a tie goes to the second
    assert tables.choose_roles(found, master="First") == ("Second", "First")
    assert tables.choose_roles({"a": found["Third"], "b": found["First"]}) == ("b", "a")
    with pytest.raises(ValueError, match="at least two"):
        tables.choose_roles({"a": found["Third"]})


def test_profile_and_head(spark, folder):
    found = tables.read_table_set(spark, folder, exclude=("Match_Results", "Extra", "Second", "First"))
    assert rows(tables.profile_tables(found)) == [("Third", 9, 0, "row_id", "bigint"), ("Third", 9, 1, "x", "string")]
    assert [r.row_id for r in tables.head(found["Third"]).collect()] == [0, 1, 2, 3, 4]


RESULTS = "match_type string, match_score double, a_row long, b_row long"


def test_results_round_trip(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("FullName", 90.0, 2, 3), ("FullAddress", 80.0, 4, 5)], RESULTS)
    kinds = lambda: rows(tables.read_results(spark, root), "match_type", "a_row")
    tables.write_results(df, root)
    tables.write_results(spark.createDataFrame([("LastName", 70.0, 6, 7)], RESULTS), root)
    tables.write_results(spark.createDataFrame([("FullName", 91.0, 8, 3)], RESULTS), root)
    assert kinds() == [("FullAddress", 4), ("FullName", 8), ("LastName", 6)]
    tables.write_results(df.where("match_type = 'FullAddress'"), root, types=["FullName", "FullAddress"])
    assert kinds() == [("FullAddress", 4), ("LastName", 6)]  # FullName was run and found nothing
    run = tables.write_run({"people": df}, df, root + "_runs", run_id="1")
    assert tables.read_results(spark, f"{run}/results").count() == 2
    assert spark.read.parquet(f"{run}/people").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_run({"people": df}, df, root + "_runs", run_id="1")


def test_run_without_results(spark, people, tmp_path):
    from kinmatch.operators.coverage import coverage, unmatched

    a = people(("ANN", "LEE", "1 A ST", "X", "OH", "1"), ("BEA", "RAY", "2 B ST", "X", "OH", "1"))
    none = spark.createDataFrame([], tables.RESULT_SCHEMA)
    found = tables.read_results(spark, tables.write_results(none, str(tmp_path / "r"), types=["FullName"]))
    run = tables.write_run({}, none, str(tmp_path / "runs"), run_id="1")
    for results in (found, tables.read_results(spark, f"{run}/results")):
        assert results.count() == 0 and unmatched(a, results).count() == 2
        assert {r.unmatched_pct for r in coverage(a, results).collect()} == {100.0}


def test_csv_keeps_values(spark, tmp_path):
    values = ['p, "q"', "two\nlines", "  blanks  ", "back\\slash", "a,b", "", None, '"', "é", "plain"]
    df = spark.createDataFrame([(str(i), v, v) for i, v in enumerate(values)], "id string, v string, w string")
    path = tables.export_csv(df.coalesce(1), str(tmp_path / "t.csv"))
    assert rows(tables.read_table(spark, path)) == sorted(((str(i), v, v) for i, v in enumerate(values)), key=repr)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|ailed"):
        tables.read_table(spark, path, multi_line=False).collect()
    plain = tables.export_csv(df.where("v not like '%lines'"), str(tmp_path / "u.csv"))
    assert tables.read_table(spark, plain, multi_line=False).count() == len(values) - 2


def test_export(spark, folder, tmp_path):
    found = tables.read_table_set(spark, folder, exclude=("Match_Results", "Extra"))
    paths = tables.export_first_two(found, str(tmp_path / "csv"))
    assert [tables.read_table(spark, p, "csv").count() for p in paths] == [3, 3]
    with pytest.raises(ValueError):
        tables.export_first_two({"a": found["First"]}, str(tmp_path / "none"))


@pytest.mark.parametrize("multi_line", [True, False])
def test_ragged_rows_are_never_cut(spark, tmp_path, multi_line):
    path = str(tmp_path / "r.csv")
    (tmp_path / "r.csv").write_text('a,b\n1,2\n3,4,5\n6\n"7,x",8\n')
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("a").collect()):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|ailed"):
            read(tables.read_table(spark, path, multi_line=multi_line))
    marked = tables.read_table(spark, path, multi_line=multi_line, ragged="mark")
    good, others = tables.split_ragged(marked)
    assert good.columns == ["a", "b"] and rows(good) == [("1", "2"), ("7,x", "8")]
    assert good.count() == 2 and others.count() == 2
    assert sorted(r[0].strip() for r in others.collect()) == ["3,4,5", "6"]
    with pytest.raises(ValueError):
        tables.read_table(spark, path, ragged="cut")


def test_interrupted_write_leaves_old_results(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    old = spark.createDataFrame([("FullName", 90.0, 2, 3), ("007", 80.0, 4, 5), ("A/b'c", 70.0, 6, 7)], RESULTS)
    new = spark.createDataFrame([("FullName", 91.0, 8, 9)], RESULTS)
    kinds = lambda: rows(tables.read_results(spark, root), "match_type", "a_row")
    tables.write_results(old, root)
    before = kinds()
    assert before == sorted([("007", 4), ("A/b'c", 6), ("FullName", 2)], key=repr)

    def stop(*args):
        raise KeyboardInterrupt

    for step in ("_publish", "read_manifest"):  # after the data are written, before anything says so
        with monkeypatch.context() as patch:
            patch.setattr(tables, step, stop)
            with pytest.raises(KeyboardInterrupt):
                tables.write_results(new, root, types=["007"])
        assert kinds() == before
    with monkeypatch.context() as patch:  # between publishing and cleaning up
        patch.setattr(tables, "_drop_unused", stop)
        with pytest.raises(KeyboardInterrupt):
            tables.write_results(new, root, types=["007"])
    assert kinds() == sorted([("A/b'c", 6), ("FullName", 8)], key=repr)
    assert tables.read_manifest(spark, root)["007"] == {"folder": None, "rows": 0}
    held = tables.read_results(spark, root)
    tables.write_results(old.where("match_type = '007'"), root)
    assert held.count() == 2  # who reads the run before is not disturbed
    tables.write_results(new.where("false"), root, types=["FullName"])
    assert kinds() == sorted([("007", 4), ("A/b'c", 6)], key=repr)
    folders = {e["folder"] for e in tables.read_manifest(spark, root).values()} - {None}
    assert len(list((tmp_path / "out").glob("run-*"))) <= len(folders) + 2


def test_unmatched_rows_of_a_run(spark, tmp_path):
    df = spark.createDataFrame([("FullName", 90.0, 2, 3)], RESULTS)
    run = tables.write_run({}, df, str(tmp_path / "runs"), run_id="2", unmatched=spark.range(3).selectExpr("id + 2 AS Original_Row_Number"))
    assert spark.read.parquet(f"{run}/Unmatched_Rows").count() == 3
    assert list(tables.read_table_set(spark, run)) == ["results"]
