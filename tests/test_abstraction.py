import random

import pytest
from pyspark.sql import functions as F

from shapelake.operators import abstraction, quality


def test_greedy_merge_matches_the_plain_loop(spark):
    rnd = random.Random(3)
    ids = {img: list(range(12)) for img in "ab"}
    pairs = [(img, a, b) for img in ids for a in ids[img] for b in ids[img] if a < b and rnd.random() < 0.3]
    want = {}
    for img in ids:
        used = set()
        for a in ids[img]:
            if a in used:
                continue
            want[img, a] = a
            for b in ids[img]:
                if b > a and b not in used and (img, a, b) in pairs:
                    used.add(b)
                    want[img, b] = a
    r = spark.createDataFrame([(i, k) for i in ids for k in ids[i]], "image_id string, region_id int")
    p = spark.createDataFrame(pairs + [("a", 3, 3)], "image_id string, a int, b int")
    assert {(x.image_id, x.region_id): x.target for x in abstraction.merge_similar(r, p).collect()} == want
    assert abstraction.merge_similar(r, p.filter("false")).filter("target != region_id").count() == 0


def test_merged_regions_add_up(spark):
    r = spark.createDataFrame([("i", 1, 0, 0, 4, 4, 2.0, 2.0, 10, 0.1, 0, 0, 0, 0.2, False), ("i", 2, 2, 2, 6, 6, 5.0, 5.0, 30, 0.3, 100, 40, 8, 0.9, True)], "image_id string, region_id int, x int, y int, w int, h int, cx double, cy double, area int, area_ratio double, r int, g int, b int, importance double, is_accent boolean")
    t = spark.createDataFrame([("i", 1, 1), ("i", 2, 1)], "image_id string, region_id int, target int")
    m = abstraction.merged_regions(r, t).first()
    assert (m.area, m.x, m.y, m.w, m.h, m.cx, m.r, m.importance, m.is_accent, m.members) == (40, 0, 0, 8, 8, 4.25, 75, 0.9, True, 2)


def test_backdrop_rings_and_skies(spark):
    images = spark.createDataFrame([("i", 100, 100)], "image_id string, width int, height int")
    rows = [("i", 1, 0, 0, 100, 60, 50.0, 20.0, 5000, 0.5, 200, 200, 210, 6000, 1), ("i", 2, 0, 0, 95, 95, 50.0, 50.0, 300, 0.03, 9, 9, 9, 9000, 1), ("i", 3, 5, 2, 80, 30, 40.0, 15.0, 1500, 0.15, 220, 220, 230, 2000, 1), ("i", 4, 5, 2, 80, 30, 40.0, 15.0, 1400, 0.14, 220, 220, 230, 2000, 1), ("i", 5, 5, 2, 80, 30, 40.0, 15.0, 1500, 0.15, 250, 20, 30, 2000, 1)]
    r = spark.createDataFrame(rows, "image_id string, region_id int, x int, y int, w int, h int, cx double, cy double, area int, area_ratio double, r int, g int, b int, outer_area int, background_id int")
    t = spark.createDataFrame([], "image_id string, a int, b int")
    assert {(x.region_id, x.why) for x in abstraction.backdrop(r, images, t).collect()} == {(1, "primary"), (2, "ring"), (3, "sky")}


def test_repair_splits_until_nothing_is_broken():
    children, leaves = {6: (4, 5), 4: (0, 1), 5: (2, 3)}, {0: {10}, 1: {11}, 2: {12}, 3: {13}, 4: {10, 11}, 5: {12, 13}, 6: {10, 11, 12, 13}}
    apart = lambda a, b, p, q: p == q
    cover, n = abstraction.repair_relations({6}, children, leaves, [(10, 12), (12, 13)], apart, lambda r, k: 1.0)
    assert cover == {4, 2, 3} and n == 2
    with pytest.raises(ValueError):
        abstraction.repair_relations({0, 1, 5}, children, leaves, [(10, 11)], lambda a, b, p, q: True, lambda r, k: 1.0)


def test_medoid_of_tiny_regions_and_ties(spark):
    px = spark.createDataFrame([("i", 1, 0, 5, 5, 5), ("i", 2, 1, 9, 9, 9), ("i", 2, 2, 9, 9, 9), ("i", 2, 3, 250, 0, 0)], "image_id string, region int, place int, r int, g int, b int")
    got = {r.region: (r.place, r.pixel_count) for r in abstraction.robust_medoid(px).collect()}
    assert got == {1: (0, 1), 2: (1, 3)} and abstraction.robust_medoid(px.filter("false")).count() == 0


def test_spatial_similarity_against_plain_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for h, w in ((6, 9), (3, 2), (4, 5)):
        a, b = rng.normal(size=(h, w, 3)), rng.normal(size=(h, w, 3))
        a[0, 0] = b[0, 0] = 0
        cos = lambda p, q: 1.0 if not p.any() and not q.any() else float(p @ q / np.linalg.norm(p) / np.linalg.norm(q))
        ys, xs = np.array_split(np.arange(h), min(4, h)), np.array_split(np.arange(w), min(4, w))
        aligned = np.mean([cos(a[y, x], b[y, x]) for y in range(h) for x in range(w)])
        coarse = np.mean([cos(a[np.ix_(y, x)].mean((0, 1)), b[np.ix_(y, x)].mean((0, 1))) for y in ys for x in xs])
        whole = cos(a.mean((0, 1)), b.mean((0, 1)))
        rows = [("k", y, x, h, w, a[y, x].tolist(), b[y, x].tolist()) for y in range(h) for x in range(w)]
        df = spark.createDataFrame(rows, "k string, y int, x int, h int, w int, a array<double>, b array<double>")
        r = quality.spatial_similarity(df, ["k"]).first()
        assert (r.whole, r.aligned, r.coarse) == pytest.approx((whole, aligned, coarse)) and r.score == pytest.approx(0.2 * whole + 0.45 * aligned + 0.35 * coarse)


def test_gap_report_errors_and_scores(spark):
    s = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 1.0), ("b", "x", float("nan")), ("b", "z", 0.1), ("c", "x", None)], "case_id string, dimension string, score double")
    g = spark.createDataFrame([("a", "FAIL"), ("b", "PASS"), ("c", None), ("d", "PASS")], "case_id string, gate string")
    got = {r.case_id: (r.gate, r.diagnostic_mean, r.errors) for r in quality.gap_report(s, g, ["x", "y"]).collect()}
    assert got["a"] == ("FAIL", 0.75, []) and got["b"] == ("PASS", None, ["missing:y", "unknown:z", "range:x"])
    assert got["c"][0] == "FAIL" and "gate" in got["c"][2] and got["d"][2] == ["missing:x", "missing:y"]


def test_palette_loss_and_forbidden_ratio_of_nothing(spark):
    t = "array<struct<l:double,a:double,b:double>>"
    d = spark.createDataFrame([([], []), ([(1.0, 0.0, 0.0)], []), ([(3.0, 4.0, 0.0)], [(0.0, 0.0, 0.0)])], f"p {t}, q {t}")
    assert [r[0] for r in d.select(quality.palette_loss(F.col("p"), F.col("q"))).collect()] == [0.0, None, 0.05]
