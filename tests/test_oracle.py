"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else x.isoformat() if hasattr(x, "isoformat") else x.item() if hasattr(x, "item") else x
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    sql = oracles.oracle_sql().get(name)
    if sql:
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
