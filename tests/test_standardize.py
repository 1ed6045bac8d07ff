import pytest

from kinmatch.operators.standardize import standardize

SHAPE = "row_id int, FirstName string, LastName string, Address string, `Address 2` string, City string, State string, Zip5 string, MD5 string"


def test_rename_merge_fill(spark):
    df = spark.createDataFrame(
        [
            (0, " Ellen\t", "Marlowe", "12 Alder St", " Apt 4 ", "Portvale", "ct", "06301", "x"),
            (1, None, None, None, None, None, None, None, None),
            (2, "A", "B", "", None, "", "CT", "06340", "x"),
        ],
        SHAPE,
    )
    got = standardize(df).orderBy("row_id").collect()
    assert got[0].asDict() == {
        "row_id": 0,
        "First_Name": "ELLEN",
        "Last_Name": "MARLOWE",
        "Address1": "12 ALDER ST APT 4",
        "City": "PORTVALE",
        "State": "CT",
        "Zip": "06301",
        "FullAddress": "12 ALDER ST APT 4, PORTVALE, CT 06301",
    }
    assert got[1].FullAddress == "" and got[1].First_Name == ""
    assert got[2].FullAddress == "CT 06340"  # only the ends are trimmed


def test_inner_holes_stay(spark):
    df = spark.createDataFrame([(0, "A", "B", "5 A ST", None, None, "CT", "06340", "x")], SHAPE)
    assert standardize(df).first().FullAddress == "5 A ST, , CT 06340"


def test_numbers_become_text(spark):
    df = spark.createDataFrame([(0, "A", "B", "5 A ST", "X", "CT", 6340)], "row_id int, First_Name string, Last_Name string, Address1 string, City string, State string, Zip int")
    assert standardize(df).first().Zip == "6340"


def test_missing_column(spark):
    with pytest.raises(KeyError, match="Missing required column: City"):
        standardize(spark.createDataFrame([(0, "A", "B", "x", "CT", "1")], "row_id int, First_Name string, Last_Name string, Address1 string, State string, Zip string"))
