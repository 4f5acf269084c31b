"""The registered queries against their SQL, on the smallest data (skipped where the data are absent)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from newsgauge.plans import load

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(load.queries()) == set(load.oracles())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mean_score" in df.columns


@pytest.mark.parametrize("name", sorted(load.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, cur.fetchall())
