"""Registered queries against their SQL in DuckDB on the smallest tables, and their contract."""

import itertools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
SLOW = {"stream_signal_stats"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def rows(names, data, side):
    order = sorted(range(len(names)), key=lambda i: names[i])
    odd = itertools.count()  # NaN equals nothing
    show = lambda v: "-" if v is None else f"nan {side} {next(odd)}" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect(), "query")
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, result.fetchall(), "SQL")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
