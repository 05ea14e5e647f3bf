"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:26].removesuffix(" 00:00:00")
    return v


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, BASE)
    columns = sorted(got.columns)
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns
