"""Every query runs on the smallest tables and, where it has SQL, agrees with DuckDB there."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith(("p3", "p6", "p7", "p8"))]


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if sql := entry.oracle_sql().get(name):
        cur = duck.sql(sql)
        assert sorted(cur.columns) == cols
        at = [cur.columns.index(c) for c in cols]
        assert got == Counter(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_entry_has_rows_and_sql_names_are_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
