"""Registered queries against DuckDB on the smallest tables: row counts, columns and values."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparkgauge.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    order = [sql.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in sql.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, duck, name):
    assert QUERIES[name](spark, SF).count() > 0
