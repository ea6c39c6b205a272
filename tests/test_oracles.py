"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.date().isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got, "a query that finds nothing proves nothing"
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[k]) for k in place) for r in want.fetchall())


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, DATA).count() > 0, name
