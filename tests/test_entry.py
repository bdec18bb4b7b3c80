"""Every query with an oracle against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from attestry.plans import oracle, workloads

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else int(v) if hasattr(v, "item") and not isinstance(v, bool) and float(v) == int(v) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(plain(x) for x in r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_the_oracle(spark, duck, name):
    assert rows(workloads.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(oracle.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(workloads.QUERIES) - set(oracle.SQL)))
def test_runs_without_an_oracle(spark, name):
    assert workloads.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(workloads.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
