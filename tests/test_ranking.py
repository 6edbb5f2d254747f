import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shapelake.operators import ranking


def test_top_per_group_with_hot_group_ties_and_clashes(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaab"), rnd.randint(0, 9), i, "x", 0) for i in range(900)] + [(None, 5, 1000, "x", 0)]
    df = spark.createDataFrame(rows, "g string, v int, id int, _part string, _r int")
    got = ranking.top_per_group(df, ["g"], [F.desc("v")], 4, ["id"])
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r[1], r[2])):
        if len(want[r[0]]) < 4:
            want[r[0]].append(r[2])
    have = defaultdict(dict)
    for r in got.collect():
        have[r.g][r["rank"]] = r.id
    assert {g: [d[k] for k in sorted(d)] for g, d in have.items()} == want
    assert set(df.columns) < set(got.columns)


def test_layer_budget_adds_up():
    layers = ["skyline", "midground", "water", "foreground", "accents"]
    add, remove = ["midground", "skyline", "foreground", "accents", "water"], ["accents", "water", "foreground", "midground", "skyline"]
    for target in (1, 5, 6, 17, 100):
        for ratios in ([1, 1, 1, 1, 1], [0.9, 0, 0, 0, 0.1], [0, 0, 0, 0, 0], [0.3, 0.3, 0.1, 0.1, 0.2]):
            got = ranking.layer_budget(target, dict(zip(layers, ratios, strict=True)), add, remove)
            assert sum(got.values()) == max(5, target) and min(got.values()) >= 1


@pytest.mark.parametrize("length", [2, 5, 100])
def test_proportional_bounds_cover_the_length(spark, length):
    shares = [0.5, 0.25, 0.125, 0.125]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(shares)] + [("z", i, 0.0) for i in range(3)], "k string, i int, share double")
    got = defaultdict(list)
    for r in ranking.proportional_bounds(df, ["k"], "share", F.lit(length), [F.col("i")]).orderBy("k", "i").collect():
        got[r.k].append((r.start, r.stop))
    for k, n in (("k", 4), ("z", 3)):
        assert len(got[k]) == n and got[k][0][0] == 0
        if length >= n:
            assert got[k][-1][1] == length and all(a[1] == b[0] for a, b in zip(got[k], got[k][1:], strict=False)) and all(b > a for a, b in got[k])
    if length == 100:
        assert [b - a for a, b in got["k"]] == [49, 25, 13, 13]


def test_even_sample_places(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, i int")
    got = defaultdict(list)
    for r in ranking.even_sample(df, ["g"], ["i"], 4).orderBy("i").collect():
        got[r.g].append(r.i)
    assert got == {"a": [0, 3, 6, 9], "b": [0, 1, 2]}


def brute_budget(features, budget):
    order = ["identity_critical", "important", "supporting", "compressible"]
    pri = lambda f: (f[1] != "required", order.index(f[2]), f[0])
    live = [f for f in features if f[1] != "forbidden" and f[3] != "omit"]
    need = [f for f in live if f[1] == "required"]
    if len(need) > budget:
        return {f[0]: None for f in features}
    got = {f[0]: 0 for f in features}
    left = budget
    for f in sorted(need, key=pri):
        got[f[0]] += 1
        left -= 1
    for f in sorted((f for f in live if f[1] == "optional"), key=pri):
        if left > 0:
            got[f[0]] += 1
            left -= 1
    ranked = sorted(live, key=pri)
    while left > 0 and ranked:
        for f in [f for f in ranked if pri(f)[:2] == pri(ranked[0])[:2]]:
            if left > 0:
                got[f[0]] += 1
                left -= 1
    return got


def test_semantic_budget_matches_the_round_robin(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(12):
        for i in range(rnd.randint(1, 8)):
            rows.append((f"c{c}", f"f{i}", rnd.choice(["required", "optional", "forbidden"]), rnd.choice(["identity_critical", "important", "supporting", "compressible"]), rnd.choice(["preserve", "symbolic", "omit", None])))
    df = spark.createDataFrame(rows, "case_id string, feature_id string, disposition string, importance string, compression_policy string")
    for budget in (0, 2, 5, 23):
        got = defaultdict(dict)
        for r in ranking.semantic_budget(df, budget).collect():
            got[r.case_id][r.feature_id] = r.allocated
        for c, have in got.items():
            want = brute_budget([(f, d, i, p or "preserve") for k, f, d, i, p in rows if k == c], budget)
            live = [1 for k, f, d, i, p in rows if k == c and d != "forbidden" and p != "omit"]
            assert have == (want if live else {f: (None if v is None else 0) for f, v in want.items()})


def test_quota_fill_and_balance(spark):
    rows = [("i", 0, "left" if k % 3 == 0 else "right" if k % 3 == 1 else "center", "sky" if k % 2 else "sea", float(k), k) for k in range(30)]
    df = spark.createDataFrame(rows, "image string, z int, side string, layer string, v double, id int")
    got = ranking.quota_with_backfill(df, ["image"], "layer", {"sky": 3, "cloud": 4}, [F.desc("v")], [F.desc("v")], ["image", "id"]).collect()
    assert sorted(r.id for r in got if r.picked == "quota") == [25, 27, 29] and sorted(r.id for r in got if r.picked == "fill") == [23, 24, 26, 28]
    flat = ranking.quota_with_backfill(df, [], "layer", {"sky": 1, "cloud": 1}, [F.desc("v")], [F.desc("v")], ["id"]).collect()
    assert sorted((r.id, r.picked) for r in flat) == [(28, "fill"), (29, "quota")]
    took = ranking.balanced_take(df, ["image"], "side", 10, [F.desc("v")], ["id"]).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in took} == {"left": 4, "right": 4, "center": 2}
    few = ranking.balanced_take(df.filter("side != 'left'"), ["image"], "side", 10, [F.desc("v")], ["id"])
    assert few.count() == 10


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_places_and_neighbours_in_hot_groups(spark, most):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 5), i, rnd.choice([None, 1.5, 2.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v double").repartition(5)
    want_i, want_v, n = {}, {}, {}
    for g in ("a", "b", None):
        group = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: r[:2])
        for i, r in enumerate(group):
            want_i[r[1]], want_v[r[1]], n[r[1]] = i + 1, group[i - 1][2] if i else None, len(group)
    got = ranking.numbered(df, ["g"], ["t", "id"], most).collect()
    assert {r.id: r._i for r in got} == want_i and {r.id: r._n for r in got} == n and len(got) == 300
    got = ranking.lagged(df, ["g"], ["t", "id"], "v", "before", most).collect()
    assert {r.id: r.before for r in got} == want_v and len(got) == 300
    assert ranking.numbered(df.filter("false"), ["g"], ["t", "id"], most).count() == 0
