"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = sorted(n for part in entry.PARTS if "llm" not in part.__name__ for n in part.QUERIES)


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return "%.9g" % v
    return v if isinstance(v, datetime.date) else str(v).removesuffix(".0") if isinstance(v, (int, np.integer)) else str(v)


def table_rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if sql := entry.oracle_sql().get(name):
        expected = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert table_rows(got) == table_rows(expected)


def test_entry(spark):
    assert entry.entry(spark).columns == ["target", "relation", "link_id"]
