import random

import pytest
from pyspark.sql import functions as F

from shapelake.operators import evaluation, graph, regions


def union_find(edges, vertices):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rnd = random.Random(2)
    n = 60
    edges = {"random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(40)], "chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)]}[kind]
    e = spark.createDataFrame([(a, b) for a, b in edges] + [(None, 1)], "a int, b int")
    v = spark.createDataFrame([(i,) for i in range(n)], "v int")
    got = {r.v: r.component for r in graph.connected_components(e, v).collect()}
    assert got == union_find(edges, range(n))
    assert graph.connected_components(e.filter("false"), v).filter("v != component").count() == 0


def test_levels_cycles_and_unknown_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6), (7, 7), (9, 1)], "a int, b int")
    v = spark.createDataFrame([(i,) for i in range(1, 9)], "v int")
    got = {r.v: r.level for r in graph.levels(e.filter("a != 9"), v).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: None, 8: 0}
    assert [r.v for r in graph.unknown_ends(e, v).collect()] == [9]


RG = "image_id string, region_id int, palette_id int, area double, area_ratio double, x int, y int, w double, h double, cx double, cy double, r int, g int, b int, touches_edge boolean, is_accent boolean, structure_score double, solidity double"


def rows():
    return [
        ("i", 0, 0, 5000.0, 0.5, 0, 0, 100.0, 100.0, 50.0, 20.0, 240, 240, 240, True, False, 0.5, 0.9),
        ("i", 1, 1, 40.0, 0.004, 10, 40, 4.0, 20.0, 12.0, 50.0, 20, 20, 20, False, False, 0.5, 0.9),
        ("i", 2, 2, 30.0, 0.003, 10, 60, 20.0, 10.0, 20.0, 65.0, 200, 30, 30, False, False, 0.5, 0.9),
        ("i", 3, 2, 25.0, 0.0025, 60, 60, 5.0, 5.0, 40.0, 65.0, 200, 30, 30, False, False, 0.5, 0.9),
        ("i", 4, 2, 28.0, 0.0028, 80, 60, 5.0, 5.0, 60.0, 65.0, 200, 30, 30, False, False, 0.5, 0.9),
        ("i", 5, 3, 900.0, 0.09, 20, 70, 80.0, 15.0, 50.0, 80.0, 30, 30, 200, True, False, 0.5, 0.9),
    ]


@pytest.fixture(scope="module")
def tables(spark):
    canvas = spark.createDataFrame([("i", 100, 100)], "image_id string, width int, height int")
    palette = spark.createDataFrame([("i", 0, 0.5, 240, 240, 240), ("i", 1, 0.1, 20, 20, 20), ("i", 2, 0.01, 200, 30, 30), ("i", 3, 0.2, 30, 30, 200)], "image_id string, palette_id int, ratio double, r int, g int, b int")
    return spark.createDataFrame(rows(), RG), palette, canvas


def test_roles_layers_and_selection(tables):
    r, palette, canvas = tables
    rated = regions.score_importance(r, palette, {"area": 0.4, "contrast": 0.3, "rarity": 0.2, "structure": 0.1}, 0.001)
    acc = {x.region_id: (x.is_accent, x.importance) for x in rated.collect()}
    assert [k for k, v in acc.items() if v[0]] == [2, 3, 4] and all(acc[k][1] >= 0.55 for k in (2, 3, 4))
    named = regions.assign_layers(regions.assign_semantics(regions.assign_roles(rated, canvas), canvas), canvas)
    role = {x.region_id: (x.role, x.semantic_type, x.layer) for x in named.collect()}
    assert role[1] == ("vertical", "elongated", "accents") and role[2][0] == "boat" and role[5] == ("water", "water", "water")
    assert role[3] == ("accent", "accent", "accents") and role[0][0] == "structure"
    assert [x.background_id for x in regions.background_region(r).collect()] == [0]
    kept = regions.keep_regions(named.withColumn("is_background", F.col("region_id") == 0), 0.0008, 4)
    assert kept.count() == 4 and 0 not in {x.region_id for x in kept.collect()}
    chosen = regions.select_layers(named, {"accents": 2, "water": 1, "foreground": 1, "skyline": 1})
    z = [x.region_id for x in regions.draw_order(chosen).orderBy("z").collect()]
    assert len(z) == 5 and z.index(0) < z.index(5)
    sub = regions.assign_semantics(regions.assign_roles(rated, canvas, subject=True), canvas, subject=True)
    assert {x.region_id: x.semantic_type for x in sub.collect()}[0] == "subject_mass"


def test_palette_patterns_and_reflections(tables, spark):
    r, palette, canvas = tables
    d = {x.palette_id: (x.role, (x.out_r, x.out_g, x.out_b)) for x in regions.design_palette(palette).collect()}
    assert d[0] == ("background", (240, 240, 240)) and d[1][0] == "dark" and d[2] == ("accent", (200, 30, 30)) and d[3][0] == "mid"
    p = regions.aligned_patterns(r, canvas).collect()
    assert [(x.palette_id, x.axis, x.members, x.spacing) for x in p] == [(2, "horizontal", 3, 20.0)]
    spaced = {x.region_id: x.cx for x in regions.respace(r, regions.aligned_patterns(r, canvas)).collect()}
    assert spaced == {2: 20.0, 3: 40.0, 4: 60.0}
    refl = r.withColumns({"role": F.lit("reflection"), "importance": F.col("region_id") / 10.0})
    assert {x.region_id for x in regions.thin_reflections(refl, 3).collect()} == {3, 4, 5}


def test_merge_costs_and_barriers(spark):
    s = "image_id string, region int, n double, l double, ca double, cb double, perimeter_px int, subject double, confidence double, anchor int, anchor_confidence double"
    stats = spark.createDataFrame([("i", 0, 100.0, 50.0, 0.0, 0.0, 40, 0.95, 0.9, 1, 0.9), ("i", 1, 100.0, 50.0, 0.0, 0.0, 40, 0.9, 0.9, 1, 0.9), ("i", 2, 400.0, 90.0, 5.0, 5.0, 80, 0.05, 0.95, 2, 0.95)], s)
    edges = spark.createDataFrame([("i", 0, 1, 20, 0.1, 0.0), ("i", 1, 2, 10, 0.9, 0.95)], "image_id string, a int, b int, shared_px int, boundary_cost double, alpha_share double")
    got = {(r.a, r.b): r for r in regions.merge_costs(edges, stats, F.lit(600.0)).collect()}
    assert got[0, 1].blocked_by == [] and got[0, 1].color_cost == 0.0 and 0 <= got[0, 1].cost < 0.3
    assert got[1, 2].cost is None and got[1, 2].blocked_by == ["subject_background", "alpha", "characteristic_anchor"]


def test_trends_and_gates(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.5, 0.4), (0.5, 0.505), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(evaluation.trend(F.col("a"), F.col("b"), 0.01)).collect()] == ["IMPROVED", "REGRESSED", "STABLE", "UNAVAILABLE"]
    t = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = spark.range(1).select(evaluation.overall_trend(t("IMPROVED", "REGRESSED")), evaluation.overall_trend(t("STABLE", "IMPROVED")), evaluation.overall_trend(t("STABLE")), evaluation.overall_trend(t("STABLE", "UNAVAILABLE")), evaluation.overall_trend(t())).first()
    assert list(r) == ["REGRESSED", "IMPROVED", "STABLE", "UNAVAILABLE", "UNAVAILABLE"]
    m = spark.createDataFrame([("c", "f", "required"), ("c", "g", "forbidden"), ("c", "h", "optional")], "case_id string, feature_id string, disposition string")
    o = spark.createDataFrame([("c", "g", "present", "s", 0.5), ("c", "zz", "present", "s", 0.5)], "case_id string, feature_id string, state string, source string, confidence double")
    rows_, unknown = evaluation.feature_survival(m, o)
    gate = evaluation.case_gate(rows_, "case_id", "failure").first()
    assert gate.gate == "FAIL" and gate.failures == ["forbidden_feature_present", "required_feature_unknown"] and unknown.count() == 1
