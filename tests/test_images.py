import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.kernels import codec, raster
from shapelake.operators import pixels
from shapelake.plans import images as I
from shapelake.sources import images as S
from shapelake.sources import sinks


def picture(kind=0):
    a = np.full((60, 80, 3), 240, np.uint8)
    a[10:50, 10:40] = (200, 30, 30)
    a[15:35, 50:70] = (30, 60, 200)
    a[40:44, 60:64] = (250, 220, 20)
    if kind:
        a[20:30, 15:25] = (20, 120, 40)
    return a


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("png")
    for k in (0, 1):
        (d / f"p{k}.png").write_bytes(codec.encode_png(picture(k)))
    (d / "alpha.png").write_bytes(codec.encode_png(np.dstack([picture(), np.where(picture()[:, :, 0] > 220, 0, 255).astype(np.uint8)])))
    (d / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (d / "photo.png").write_bytes(b"\xff\xd8\xff\xe0 jpeg")
    return str(d)


@pytest.fixture(scope="module")
def decoded(spark, folder):
    files, _ = S.read_files(spark, folder, "*.png")
    d = S.decode(files.withColumn("path", F.element_at(F.split("path", "/"), -1))).cache()
    yield d
    d.unpersist()


def test_decoding_agrees_with_the_built_in_source(spark, folder, decoded):
    own = {r.image_id: r for r in decoded.collect()}
    assert own["broken.png"].error and own["photo.png"].error == "format without decoder" and own["p0.png"].error is None
    theirs = {r.image_id.rsplit("/", 1)[1]: r for r in S.read_images(spark, folder).collect()}
    for n in ("p0.png", "p1.png", "alpha.png"):
        assert bytes(own[n].data) == bytes(theirs[n].data) and (own[n].width, own[n].height) == (80, 60)
    assert S.read_files(spark, folder, "*.png", most_bytes=5)[0].count() == 0
    px = pixels.to_pixels(decoded)
    assert px.filter("image_id = 'p0.png'").count() == 4800
    assert {r.image_id: r.transparent for r in pixels.has_transparency(px).collect()} == {"p0.png": False, "p1.png": False, "alpha.png": True}
    flat = pixels.flatten_alpha(px.filter("image_id = 'alpha.png'"), (1, 2, 3)).filter("y = 0 and x = 0").first()
    assert (flat.r, flat.g, flat.b) == (1, 2, 3)


def test_signatures_and_survival(decoded):
    px = pixels.to_pixels(decoded)
    sizes = decoded.filter("error is null").select("image_id", "width", "height")
    s = pixels.color_signatures(px, sizes)
    p0 = {(r.r, r.g, r.b): r for r in s.filter("image_id = 'p0.png'").collect()}
    red = p0[(208, 16, 16)]
    assert red.share == 1200 / 4800 and red.cx == pytest.approx(24.5 / 79) and len(p0) == 4
    base = s.filter("image_id = 'p1.png'").withColumn("image_id", F.lit("c"))
    cur = s.filter("image_id = 'p0.png'").withColumn("image_id", F.lit("c"))
    missing, gate = pixels.survival(base, cur)
    assert [(r.r, r.g, r.b) for r in missing.collect()] == [(16, 112, 48)] and not gate.first().passed
    missing, gate = pixels.survival(base, cur, source=cur)
    assert missing.count() == 0 and gate.first().passed
    assert pixels.survival(base, cur.filter("false"))[0].count() == base.count()
    same = pixels.changed_share(px.filter("image_id = 'p0.png'").withColumn("image_id", F.lit("c")), px.filter("image_id = 'p1.png'").withColumn("image_id", F.lit("c"))).first()
    assert same.changed == 100 / 4800
    ok = {r.image_id: (r.colors, r.sane) for r in pixels.sanity(px).collect()}
    assert ok["p0.png"] == (4, True)


def test_region_statistics_merge_to_those_of_unions(spark):
    a = np.random.default_rng(1).integers(0, 4, (12, 15))
    lab = spark.createDataFrame([("i", int(y), int(x), int(a[y, x]), float(x * y)) for y in range(12) for x in range(15)], "image_id string, y int, x int, region int, v double")
    parts = pixels.region_stats(lab, {"v": F.col("v")})
    mapping = spark.createDataFrame([("i", k, k // 2) for k in range(4)], "image_id string, region int, target int")
    whole = pixels.region_stats(lab.withColumn("region", F.floor(F.col("region") / 2).cast("int")), {"v": F.col("v")})
    key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert key(pixels.merge_stats(parts, mapping)) == key(whole)
    adj = {(r.a, r.b): r.shared_px for r in pixels.adjacency(lab).collect()}
    want = {}
    for p, q in [(a[:, :-1], a[:, 1:]), (a[:-1], a[1:])]:
        for u, v in zip(p.reshape(-1), q.reshape(-1), strict=True):
            if u != v:
                want[min(u, v), max(u, v)] = want.get((min(u, v), max(u, v)), 0) + 1
    assert adj == want
    runs = pixels.encode_runs(lab.filter("region = 1"), ["image_id"])
    good, bad = pixels.decode_runs(runs, ["image_id"], 15)
    assert {(r.y, r.x) for r in good.collect()} == set(zip(*map(list, np.nonzero(a == 1)), strict=True)) and bad.count() == 0
    wrong = spark.createDataFrame([("i", 0, 0, 4), ("i", 0, 3, 6), ("i", 1, 5, 5), ("i", 2, -1, 2), ("i", 3, 9, 99)], "image_id string, y int, x0 int, x1 int")
    assert pixels.decode_runs(wrong, ["image_id"], 15)[1].count() == 4


def test_color_strip_finds_exact_shares(decoded):
    px = pixels.to_pixels(decoded.filter("image_id = 'p0.png'"))
    strip = I.color_strip(px, 3, length=100).collect()
    assert {r.hex for r in strip} == {"#f0f0f0", "#c81e1e", "#1e3cc8"}
    assert sum(r.pixels for r in strip) == 4800 and sorted((r.start, r.stop) for r in strip)[-1][1] == 100
    assert next(r.pixels for r in strip if r.hex == "#c81e1e") == 1200
    featured = I.color_strip(px, 4, feature=True)
    assert "#fadc14" in {r.hex for r in featured.collect()}
    svg = I.strip_svg(I.color_strip(px, 3, length=100), 100, 20).first().svg
    assert svg.count("<rect") == 3


def test_feature_palette_leaves_the_backdrop_out(decoded):
    rows = I.feature_palette(decoded.filter("error is null")).filter("image_id = 'p0.png'").collect()
    # the deep blue's hue lies in purple's range; the backdrop would be white
    assert {r.family for r in rows} == {"red", "purple", "yellow"}
    assert [r.role for r in sorted(rows, key=lambda r: r.rank)][0] == "main"


def test_stable_scene_redraws_the_picture(decoded, tmp_path):
    out = I.stable_scene(decoded.filter("image_id in ('p0.png', 'p1.png')"), shapes=12, colors=5)
    shapes = out["shapes"].cache()
    assert {r.image_id for r in shapes.collect()} == {"p0.png", "p1.png"}
    drawn = sinks.render(shapes, out["canvas"]).filter("image_id = 'p0.png'").first()
    a = np.frombuffer(drawn.data, np.uint8).reshape(drawn.height, drawn.width, 4)[:, :, 2::-1].astype(int)
    assert np.abs(a - picture().astype(int)).mean() < 12
    again = sinks.content_digest(I.stable_scene(decoded.filter("image_id in ('p0.png', 'p1.png')").repartition(3), shapes=12, colors=5)["shapes"], ["image_id"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in sinks.content_digest(shapes, ["image_id"]).collect()}
    svg = sinks.shapes_svg(shapes, out["canvas"])
    assert svg.filter("svg like '<svg%' and svg like '%</svg>'").count() == 2
    png = sinks.encode_png(sinks.render(shapes, out["canvas"]))
    assert codec.decode_png(bytes(png.first().png)).shape == (60, 80, 4)
    sinks.write_texts(svg, f"{tmp_path}/svg", "image_id", "svg")
    shapes.unpersist()


def test_hierarchical_cuts_partition_pixels_and_nest(decoded):
    out = I.hierarchical_scene(decoded.filter("image_id = 'p1.png'"), (4, 8, 16))
    cuts = out["cuts"].toPandas()
    n = out["labels"].select("region").distinct().count()
    for wanted in (4, 8, 16):
        c = cuts[cuts.wanted == wanted]
        assert len(c) == n and c.region.is_unique and c.node.nunique() == wanted
    fine, coarse = (cuts[cuts.wanted == k].set_index("region").node for k in (16, 4))
    assert (coarse.groupby(fine).nunique() == 1).all()
    per = out["selected"].groupBy("wanted").agg(F.count("*").alias("n"), F.count_distinct("y", "x").alias("d")).collect()
    assert all(r.n == r.d == 4800 for r in per)
    chains = I.boundary_chains(out["selected"].filter("wanted = 4"), ["image_id", "wanted"])
    sides = {r.a for r in chains.collect()} | {r.b for r in chains.collect()}
    assert sides - {-1} == set(cuts[cuts.wanted == 4].node)


def test_sources_of_manifests_masks_and_assets(spark, tmp_path):
    doc = {"schema_version": "1.0", "case_id": "c", "features": [{"id": "f", "semantic_role": "hair", "disposition": "required", "importance": "important"}, {"id": "f", "disposition": "odd", "importance": "important"}], "relations": [{"subject": "f", "predicate": "p", "object": "ghost"}], "evaluation_regions": [{"id": "r", "feature_ids": ["f", "none"]}]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "m/b.json").write_text('{"case_id": "d"')
    good, bad = S.read_documents(spark, str(tmp_path / "m"), S.SEMANTIC_MANIFEST)
    assert [r.case_id for r in good.collect()] == ["c"] and bad.count() == 1
    assert {(r.error, r.value) for r in S.manifest_errors(good).collect()} == {("disposition", "odd"), ("repeated feature", "f"), ("unknown feature in relation", "ghost"), ("unknown feature in region", "none")}
    np.savez(tmp_path / "m/maps.npz", hair=np.array([[0, 0.5], [1.0, 0]]), odd=np.zeros(3))
    (tmp_path / "m/bad.npz").write_bytes(b"x")
    files, _ = S.read_files(spark, str(tmp_path / "m"), "*.npz")
    assert {(r.label, r.y, r.x, r.confidence) for r in S.read_confidence_maps(files).collect()} == {("hair", 0, 1, 0.5), ("hair", 1, 0, 1.0)}
    sha = files.filter("path like '%maps.npz'").first().sha256
    asset = lambda n, d: {"file_name": n, "drive_file_id": None, "sha256": d, "media_type": None}
    cases = spark.createDataFrame([("1", "c", {"source": asset("maps.npz", sha.upper()), "golden": asset("bad.npz", "0" * 64), "current": asset("gone.npz", "1" * 64)})], S.GOLDEN_CASE)
    assert {r.asset: r.status for r in S.verify_assets(cases, files).collect()} == {"source": "PASS", "golden": "FAIL", "current": "FAIL"}


def test_delivery_fails_open_and_logs_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")

    def send(row):
        if row["k"] == 2:
            raise OSError("down")
        return "STORED" if row["k"] == 1 else "odd"

    assert {r.k: (r.delivery, r.delivery_error) for r in sinks.deliver(df, send).collect()} == {1: ("STORED", None), 2: ("FAILED", "OSError: down"), 3: ("FAILED", "unknown answer odd")}
    for _ in range(2):
        sinks.write_lines(df, f"{tmp_path}/log")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(lines) == 6 and '{"k":2,"v":null}' in lines
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 3
