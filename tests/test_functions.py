import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import color, geometry, text, vectors
from shapelake.kernels import raster

# Published CIEDE2000 test pairs (L1 a1 b1 L2 a2 b2 difference).
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (50.0, 2.5, 0.0, 58.0, 24.0, 15.0, 19.4535),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_ciede2000_published_pairs(spark):
    df = spark.createDataFrame([((a, b, c), (d, e, f), v) for a, b, c, d, e, f, v in PAIRS], "p struct<l:double,a:double,b:double>, q struct<l:double,a:double,b:double>, want double")
    out = color.with_delta_e2000(df, "p", "q")
    assert out.columns == ["p", "q", "want", "delta_e"]
    for r in out.collect():
        assert r.delta_e == pytest.approx(r.want, abs=5e-5)


def test_lab_round_trip_and_families(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(int, v)) for v in rng.integers(0, 256, (200, 3))] + [(0, 0, 0), (255, 255, 255)]
    df = spark.createDataFrame(rows, "r int, g int, b int").withColumn("lab", color.lab(F.col("r"), F.col("g"), F.col("b")))
    for r in df.withColumn("back", color.rgb(F.col("lab"))).collect():
        assert (r.back.r, r.back.g, r.back.b) == (r.r, r.g, r.b)
        assert tuple(r.lab) == pytest.approx(tuple(raster.to_lab(np.array([r.r, r.g, r.b]))), abs=1e-9)
        assert tuple(r.lab) == pytest.approx(color.lab_of((r.r, r.g, r.b)), abs=1e-9)
    named = spark.createDataFrame([(n, *v) for n, v in color.FAMILY_ANCHORS.items()], "name string, r int, g int, b int").withColumn("lab", color.lab(F.col("r"), F.col("g"), F.col("b")))
    for r in named.withColumn("family", color.color_family(F.col("lab"), F.lit(None))).collect():
        assert r.family == r.name


def test_color_helpers(spark):
    r = spark.range(1).select(
        color.hex_color(F.lit(255), F.lit(0), F.lit(10)).alias("hex"),
        color.quantize(F.lit(255)).alias("q"),
        color.blend(F.lit(1), F.lit(2), F.lit(0.5)).alias("half"),
        color.saturation(F.lit(0), F.lit(0), F.lit(0)).alias("black"),
        color.composite(F.lit(100), F.lit(0), F.lit(7)).alias("clear"),
        color.hue_degrees(F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(-1.0).alias("b"))).alias("hue"),
    ).first()
    assert (r.hex, r.q, r.half, r.black, r.clear, r.hue) == ("#ff000a", 240, 2, 0.0, 7, 270.0)


def test_boxes_polygons_and_areas(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("double")
    r = spark.range(1).select(
        geometry.polygon_area(pts).alias("area"),
        geometry.perimeter(pts).alias("round"),
        geometry.polygon_area(F.slice(pts, 1, 2)).alias("flat"),
        geometry.box_overlap(box(0, 0, 10, 10), box(5, 5, 2, 20)).alias("over"),
        geometry.box_overlap(box(0, 0, 0, 0), box(0, 0, 5, 5)).alias("none"),
        geometry.clip_box(box(-5, 2, 10, 50), F.lit(8), F.lit(9)).alias("clip"),
        geometry.clip_box(box(9, 0, 5, 5), F.lit(8), F.lit(9)).alias("gone"),
        geometry.points_box(pts).alias("pbox"),
        geometry.transform_points(pts, F.lit(2.0), F.lit(1.0), F.lit(0.0))[2]["x"].alias("moved"),
        geometry.pad_points(pts, F.lit(100), F.lit(100), F.lit(0.1))[0]["x"].alias("padded"),
        geometry.shape_area(F.lit("circle"), none, none, F.lit(2.0), none, F.lit(None).cast("array<struct<x:double,y:double>>")).alias("circle"),
        geometry.circularity(F.lit(math.pi), F.lit(2 * math.pi)).alias("circ"),
        geometry.vertex_count(F.lit("line"), pts).alias("v"),
    ).first()
    assert (r.area, r.round, r.flat, r.over, r.none, r.clip, r.gone, r.pbox) == (12.0, 14.0, 0.0, 0.25, 0.0, [0.0, 2.0, 5.0, 7.0], None, [0.0, 0.0, 4.0, 3.0])
    assert r.moved == 9.0 and r.padded == 10.0 and r.circle == pytest.approx(4 * math.pi) and r.circ == pytest.approx(1.0) and r.v == 2


def test_text_helpers(spark):
    import hashlib

    r = spark.range(1).select(
        text.stable_id("evt_", F.lit("a"), F.lit("b")).alias("id"),
        text.is_sha256(F.lit("A" * 64)).alias("upper"),
        text.is_sha256(F.lit(None).cast("string")).alias("null"),
        text.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")).alias("json"),
        text.first_label(F.lit("Round GLASSES"), ["sun", "glasses", "round"]).alias("label"),
        text.lookup({"x": 1.0}, F.lit("y"), 0.5).alias("default"),
        text.reasons(a=F.lit(True), b=F.lit(None).cast("boolean"), c=F.lit(True)).alias("why"),
    ).first()
    assert r.id == "evt_" + hashlib.sha256(b"a\x1fb").hexdigest()[:32]
    assert (r.upper, r.null, r.json, r.label, r.default, r.why) == (False, False, '{"a":null,"b":1}', "glasses", 0.5, ["a", "c"])


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = spark.range(1).select(
        vectors.cosine(v(1, 0), v(1, 1)).alias("c"),
        vectors.cosine(v(0, 0), v(0, 0), both_zero=1.0).alias("z"),
        vectors.cosine_loss(v(0, 0), v(1, 1)).alias("l"),
        vectors.normalize(v(3, 4)).alias("n"),
        vectors.normalize(v(0, 0)).alias("n0"),
        vectors.squared_distance(v(1, 2), v(3, 5)).alias("d"),
        vectors.mean_distance(v(), v()).alias("m"),
    ).first()
    assert r.c == pytest.approx(math.sqrt(0.5)) and (r.z, r.l, r.n, r.n0, r.d, r.m) == (1.0, 1.0, [0.6, 0.8], [0.0, 0.0], 13.0, 0.0)
