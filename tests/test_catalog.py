"""Every registered track query against its SQL on the driver's smallest tables; those without SQL against rows and invariants."""

import glob
import math
import os

import pytest
from trackloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
