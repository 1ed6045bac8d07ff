"""Record standardisation: one fixed schema, upper case, no nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text

# Alternative column names.
RENAMES = {"FirstName": "First_Name", "LastName": "Last_Name", "Address": "Address1", "Zip5": "Zip"}
REQUIRED = ("First_Name", "Last_Name", "Address1", "City", "State", "Zip")
SECOND_LINE = "Address 2"


def standardize(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Give ``row_id``, the six required columns and ``FullAddress``; drop all others."""
    source = {RENAMES.get(c, c): f"`{c}`" for c in df.columns}
    missing = [c for c in REQUIRED if c not in source]
    if missing:
        raise KeyError(f"Missing required column: {missing[0]}")
    if SECOND_LINE in source:
        line2 = text.strip(f"coalesce(CAST({source[SECOND_LINE]} AS STRING), '')")
        source["Address1"] = f"concat(coalesce(CAST({source['Address1']} AS STRING), ''), ' ', {line2})"
    plain = df.selectExpr(
        f"CAST(`{row_id}` AS BIGINT) AS row_id", *(f"{text.fold(source[c])} AS {c}" for c in REQUIRED)
    )
    full = "btrim(concat(Address1, ', ', City, ', ', State, ' ', Zip), ', ')"
    return plain.selectExpr("*", f"{full} AS FullAddress")
