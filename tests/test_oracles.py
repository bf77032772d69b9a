"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from tessella import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(got, columns):
    return sorted((tuple(plain(r[i]) for i in columns) for r in got), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows([tuple(r) for r in df.select(*columns).collect()], range(len(columns)))
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == rows(out.fetchall(), [names.index(c) for c in columns])


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
