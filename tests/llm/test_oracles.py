"""The registered queries that SQL can express against DuckDB."""

import os

import pytest

from kinmatch.llm.oracles import statements
from kinmatch.llm.queries import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(statements()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    cursor = duck.execute(statements()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
