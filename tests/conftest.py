import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from auditlake.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def rows(spark):
    """rows(schema, row, ...) makes a table; clashing names of helper columns are part of the tests that use it."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
