import random

import pytest

from shapelake.operators import references

PARENTS = "k string, s bigint, e bigint"
REFS = "k string, t bigint, tbl string, ref_field string, row_id bigint, period string, received bigint"


def brute(parents, refs):
    out = {}
    for k, t, tbl, f, rid, period, received in refs:
        if k is None:
            continue
        own = [(s, e) for pk, s, e in parents if pk == k]
        if not own:
            kind = "missing"
        elif t is None or any(s is not None and s <= t and (e is None or t < e) for s, e in own):
            continue
        else:
            kind = "deleted" if any(s is not None and s <= t for s, e in own) else "late"
        out[tbl, f, rid] = max(out.get((tbl, f, rid), (-1,)), (received, period, kind))
    return {(*k, v[1], v[2]) for k, v in out.items()}


def run(spark, parents, refs, **kw):
    p, r = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(refs, REFS)
    got = references.one_per_reference(references.orphan_references(p, r, **kw)).collect()
    assert len(got) == len(set(got))
    return {tuple(x) for x in got}


@pytest.mark.parametrize(("split", "cut"), [(7, 1_000_000), (2_000_000, 5), (11, 3), (2_000_000, 1_000_000)])
def test_random_intervals_match_brute_force(spark, split, cut):
    rnd = random.Random(5)
    keys = [f"adoption:{i}" for i in range(40)] + ["path:ü", "path: "]
    parents = [(rnd.choice(keys[:30] + ["adoption:0"] * 30), rnd.choice([None, rnd.randint(0, 50), 7]), rnd.choice([None, rnd.randint(0, 60), 7])) for _ in range(150)]
    refs = [(rnd.choice(keys + ["adoption:0"] * 20 + [None]), rnd.randint(-2, 60), rnd.choice("ab"), "f", i // 2, f"2025-{i % 12 + 1:02d}", rnd.randint(0, 3)) for i in range(600)]
    assert run(spark, parents, refs, ranges=5 if split < 10 else None, parents_per_range=20, refs_per_split=split, parents_per_slice=cut) == brute(parents, refs)


def test_bounds_of_an_interval(spark):
    parents = [("k", 10, 20), ("k", 30, None), ("n", None, None)]
    refs = [("k", t, "t", "f", t, "p", 1) for t in (9, 10, 19, 20, 29, 30, 99)] + [("n", 5, "t", "f", 1, "p", 1), ("m", 5, "t", "f", 2, "p", 1)]
    want = {("t", "f", 9, "p", "late"), ("t", "f", 20, "p", "deleted"), ("t", "f", 29, "p", "deleted"), ("t", "f", 1, "p", "late"), ("t", "f", 2, "p", "missing")}
    assert run(spark, parents, refs) == want


def test_no_parents_no_references_null_times(spark):
    refs = [("k", 5, "t", "f", 1, "p", 1), ("k", None, "t", "f", 2, None, 1)]
    assert run(spark, [], refs) == {("t", "f", 1, "p", "missing"), ("t", "f", 2, None, "missing")}
    assert run(spark, [("k", 1, None)], []) == set()
    assert run(spark, [("k", 1, 2)], refs) == {("t", "f", 1, "p", "deleted")}


def test_keys_with_equal_digests_are_told_apart():
    import numpy as np

    r = references._Range(np.array([1, 1, 1, 9]), ["a", "a", "b", "c"], np.array([1, 5, 3, 1]), np.array([2, 9, 4, 2]))
    kind = r.probe(np.array([1, 1, 1, 1, 9, 5]), np.array(["a", "b", "b", "x", "c", "z"], object), np.array([6, 3, 4, 3, 0, 0]))
    assert kind.tolist() == [0, 0, 2, 1, 3, 1]


def test_only_hot_keys_are_copied_so_rows_stay_linear(spark, monkeypatch):
    packed = []
    probed = references._probed
    monkeypatch.setattr(references, "_probed", lambda df: packed.append(df) or probed(df))
    n, cut, split = 4000, 100, 200
    parents = [(f"k{i}", i, i + 5) for i in range(n)] + [("hot", i, i + 1) for i in range(n)]
    refs = [(f"k{i}", i, "t", "f", i, "p", 1) for i in range(n)] + [("hot", i + (i % 2) * n, "t", "f", n + i, "p", 1) for i in range(n)]
    got = run(spark, parents, refs, refs_per_split=split, parents_per_slice=cut, parents_per_range=50)
    assert got == brute([x for x in parents if x[0] == "hot"], [x for x in refs if x[0] == "hot"])
    rows = packed[0].groupBy("is_ref").count().collect()
    assert {r["is_ref"]: r["count"] for r in rows}[True] == len(refs)
    # every slice of the hot key is copied once per split of its references, no other parent is
    assert n * 2 <= {r["is_ref"]: r["count"] for r in rows}[False] <= 2 * n + 4 * n / cut + (cut + 2) * n / split
    assert packed[0].groupBy("rng", "slice", "sub").count().agg({"count": "max"}).first()[0] <= 3 * (cut + split)
