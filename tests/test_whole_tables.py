"""Queries over whole tables against brute force over all rows."""

from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shapelake.plans import analog


@pytest.mark.parametrize(("name", "key"), [("q_overlap_all", "c_nationkey"), ("q_overlap_customer", "o_custkey")])
def test_overlaps_take_all_orders(spark, data, name, key):
    groups = defaultdict(list)
    for k, i, x, y in duckdb.sql(f"SELECT {key}, o_orderkey, o_totalprice / 1000, day(o_orderdate) FROM '{data}/orders.parquet' JOIN '{data}/customer.parquet' ON o_custkey = c_custkey").fetchall():
        groups[k].append((i, float(x), y))
    want = {}
    for rows in groups.values():
        for (i, x, y), (j, u, v) in combinations(sorted(rows), 2):
            if (w := 8 - abs(x - u)) > 0 and (h := 4 - abs(y - v)) > 0:
                want[i, j] = w * h / 32
    rows = entry.queries()[name](spark, data).collect()
    got = {(r.a, r.b): r.overlap for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    low = {i for (i,) in duckdb.sql(f"SELECT o_orderkey FROM '{data}/orders.parquet' WHERE o_totalprice < 400000").fetchall()}
    assert any(a in low and b in low for a, b in got)


def test_overlaps_round_as_their_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("orders", "customer"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = Counter(db.sql(entry.oracle_sql()["q_overlap_all"]).fetchall())
    assert Counter(map(tuple, entry.queries()["q_overlap_all"](spark, folder).collect())) == want


def test_numbers_round_as_in_duckdb(spark):
    values = [k / 2e6 for k in range(400)] + [k / 1e6 / 32 for k in range(3000)] + [0.5122125, 0.1269475, 0.2513025, 0.49999999999999994e-6, 1.0]
    want = [v for (v,) in duckdb.sql("SELECT round(unnest($1::DOUBLE[]), 6)", params=[values]).fetchall()]
    d = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.v for r in d.select("i", analog.r6_binary(F.col("v")).alias("v")).orderBy("i").collect()] == want


def test_composition_takes_all_line_items(spark, data):
    rows = lambda sql: duckdb.sql(sql).fetchall()
    orders, brands = dict(rows(f"SELECT o_orderkey, o_custkey FROM '{data}/orders.parquet'")), dict(rows(f"SELECT p_partkey, p_brand FROM '{data}/part.parquet'"))
    known = {k for (k,) in rows(f"SELECT c_custkey FROM '{data}/customer.parquet' WHERE c_acctbal > 0")}
    items = rows(f"SELECT l_orderkey, l_linenumber, l_partkey FROM '{data}/lineitem.parquet'")
    want = Counter((o, n, p, brands[p], orders[o] not in known) for o, n, p in items if o in orders and p in brands)
    assert Counter(map(tuple, entry.queries()["q_compose_all"](spark, data).collect())) == want


def test_components_take_all_orders(spark, data):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for (k,) in duckdb.sql(f"SELECT DISTINCT o_custkey FROM '{data}/orders.parquet'").fetchall():
        a, b = sorted((find(k), find(k // 3 * 2)))
        root[b] = a  # the lesser is the root
    got = entry.queries()["q_components_all"](spark, data).collect()
    assert len(got) == len(root) and {r.v: r.component for r in got} == {v: find(v) for v in root}
