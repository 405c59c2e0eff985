"""Queries give the same rows as their SQL on the smallest data.

The headline queries by default; all of them with ALL_QUERIES=1 (or tools/check_oracle.py).
"""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from bench import HEADLINE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v), 0.0)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return (1, "nan" if math.isnan(f) else "", 0.0 if math.isnan(f) else f)
    if isinstance(v, (dt.datetime, dt.date)):
        return (2, v.isoformat(), 0.0)
    return (2, str(v), 0.0)


NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else [n for n in HEADLINE if n in SQL]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a[:2] == b[:2]
            assert a[2] == b[2] or math.isclose(a[2], b[2], rel_tol=1e-6, abs_tol=2e-3), (g, w)


def test_every_query_has_a_covering_row():
    from tablewright import catalog
    rows = catalog.coverage()
    wanted = ([f"A{i}" for i in range(1, 10)] + [f"B{i}" for i in range(1, 11)] + [f"C{i}" for i in range(1, 8)]
              + [f"D{i}" for i in range(1, 37)] + [f"E{i}" for i in range(1, 13)] + [f"F{i}" for i in range(1, 9)]
              + [f"G{i}" for i in range(1, 5)] + [f"H{i}" for i in range(1, 22)] + [f"L{i}" for i in range(1, 12)]
              + [f"I{i}" for i in range(1, 18)] + [f"J{i}" for i in range(1, 15)] + [f"K{i}" for i in range(1, 17)]
              + [f"M{i}" for i in range(1, 11)] + [f"N{i}" for i in range(1, 9)] + [f"O{i}" for i in range(1, 13)]
              + [f"P{i}" for i in range(1, 7)] + [f"U{i}" for i in range(1, 6)])
    assert [r for r in wanted if r not in rows] == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11
