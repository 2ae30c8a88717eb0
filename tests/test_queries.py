"""Every query that has an oracle, against it, on the smallest tables; the others must give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from regionframe import catalog

SF = "/root/testdata/sf0.001"


def rounded(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        r = db.sql(catalog.ORACLES[name])
        columns = sorted(df.columns)
        assert sorted(r.columns) == columns
        mine = sorted((tuple(rounded(x[c]) for c in columns) for x in got), key=repr)
        theirs = sorted((tuple(rounded(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 64
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
