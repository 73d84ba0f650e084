"""Every query against its SQL in DuckDB, on the smallest test tables."""

import glob
import math
import os

import pytest

from corvane.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda x: (None if math.isnan(x) else round(x, 6)) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql()[name]  # every query has its SQL
    assert rows, "a query without rows proves nothing"
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(got.fetchall(), cols)
