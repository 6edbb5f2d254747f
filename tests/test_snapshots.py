from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shapelake.operators import snapshots

T0 = datetime(2025, 1, 1)
SCHEMA = """snapshot_no int, received_at timestamp_ntz, case_id string, determinism_sha256 string,
hard_evidence map<string,struct<status:string,passed:boolean,reason:string>>, pair string, stamp int"""


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = snapshots.snapshot_changes(
        df,
        "snapshot_no",
        F.lower(F.trim("case_id")),
        "received_at",
        [snapshots.digest_value(F.col("determinism_sha256")), snapshots.passed_entries(F.col("hard_evidence"))],
    )
    return {tuple(r) for r in out.collect()}


def ev(**k):
    return {n: ("s", v, "why") for n, v in k.items()}


def at(h):
    return T0 + timedelta(hours=h)


def test_added_removed_changed_over_gaps(spark):
    rows = [
        (1, at(0), "A", "d1", ev(a=True)),
        (1, at(0), "b", "d1", ev(a=True)),
        (3, at(1), " a ", "SHA256:D1", ev(a=True, z=None)),  # same digest, absent equals null
        (3, at(1), "c", None, None),
        (7, at(2), "a", "d2", ev(a=True)),
        (7, at(2), "C", "", None),  # null differs from any value
    ]
    assert changes(spark, rows) == {(3, "b", "removed"), (3, "c", "added"), (7, "a", "changed"), (7, "c", "changed")}


def test_last_received_counts_and_ties_are_stable(spark):
    rows = [
        (1, at(0), "a", "x", None),
        (2, at(9), "a", "x", None),  # received last: unchanged
        (2, at(1), "a", "y", None),
        (2, None, "a", "z", None),  # a null time is oldest
        (3, at(1), "a", "p", None),
        (3, at(1), "a", "q", None),
    ]
    first = changes(spark, rows)
    assert first == {(3, "a", "changed")}
    assert changes(spark, rows[::-1]) == first


def test_passed_flips_and_order_does_not_matter(spark):
    rows = [
        (1, at(0), "a", "x", ev(m=True, n=False)),
        (1, at(0), "b", "x", ev(m=True)),
        (2, at(0), "a", "x", ev(n=False, m=True)),
        (2, at(0), "b", "x", ev(m=False)),
    ]
    assert changes(spark, rows) == {(2, "b", "changed")}


def test_empty_single_and_null_keys(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, at(0), "a", "x", None)]) == set()
    assert changes(spark, [(1, at(0), None, "x", None), (2, at(0), None, "y", None), (None, at(0), "a", "y", None)]) == set()


def test_hot_key_combines_before_the_shuffle(spark):
    rows = [(s, at(i), "hot", f"d{s}", None) for s in (1, 2) for i in range(300)] + [(1, at(0), f"k{i}", "d", None) for i in range(20)]
    assert changes(spark, rows) == {(2, "hot", "changed")} | {(2, f"k{i}", "removed") for i in range(20)}
