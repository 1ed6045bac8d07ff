import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kinmatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Build standard records from (first, last, street, city, state, zip) tuples, numbered from 0."""
    from helpers import RECORD

    from kinmatch.operators.standardize import standardize

    def build(*records):
        return standardize(spark.createDataFrame([(i, *r) for i, r in enumerate(records)], RECORD))

    return build
