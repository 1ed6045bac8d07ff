"""Every registered query against its SQL, run by DuckDB on the same tables."""

import os

import pytest

from kinmatch.plans.catalog import registered
from kinmatch.plans.oracles import oracle_statements

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def _plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(registered()))
def test_equals_sql(spark, duck, name):
    df = registered()[name](spark, SF_DIR)
    got = _plain(df.columns, df.collect())
    if name not in oracle_statements():
        assert got[1]
        return
    cursor = duck.execute(oracle_statements()[name])
    assert got == _plain([c[0] for c in cursor.description], cursor.fetchall())
