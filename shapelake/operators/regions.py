"""Region tables: roles, layers, importance, filters, palettes, patterns, merge costs.

A region row has image_id, region_id, x, y, w, h (box), cx, cy (center), area, area_ratio, r, g, b,
palette_id, touches_edge, is_accent, and the columns the operators add. ``images``: image_id, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import color
from shapelake.operators.ranking import quota_with_backfill, top_per_group

# Draw order of composition layers.
LAYER_ORDER = {
    "water_base": 5,
    "skyline_base": 10,
    "subject_base": 15,
    "skyline": 20,
    "character_body_base": 27,
    "character_body_detail": 29,
    "midground": 30,
    "character_outfit_base": 31,
    "character_hair_base": 32,
    "character_outfit_detail": 33,
    "character_face_base": 34,
    "character_prop_base": 36,
    "character_hair_detail": 38,
    "water": 40,
    "foreground": 40,
    "accents": 50,
    "character_outfit_accessory": 52,
    "character_prop_detail": 54,
    "character_face_detail": 55,
    "lines": 60,
}


def _shape(r: DataFrame, images: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    d = r.join(images.select("image_id", F.col("width").alias("_W"), F.col("height").alias("_H")), "image_id")
    c = F.col
    tall, wide = c("h") / F.greatest(F.lit(1.0), c("w")), c("w") / F.greatest(F.lit(1.0), c("h"))
    return d, {"tall": tall, "wide": wide, "cy": c("cy") / c("_H"), "bw": c("w") / c("_W"), "bh": c("h") / c("_H"), "sat": color.saturation(c("r"), c("g"), c("b")), "lum": color.brightness(c("r"), c("g"), c("b"))}


def assign_roles(regions: DataFrame, images: DataFrame, subject: bool = False) -> DataFrame:
    """Role of each region by the first rule that holds: geometry first, small saturated accents late."""
    # The limits in these rules, in their order.
    d, m = _shape(regions, images)
    a, edge, accent = F.col("area_ratio"), F.col("touches_edge"), F.col("is_accent")
    if subject:
        role = F.when(accent & (a <= 0.0035) & (m["sat"] >= 0.30), "accent").when((m["tall"] >= 2.2) & (a <= 0.010), "vertical").when(a >= 0.0015, "structure").otherwise("misc")
    else:
        boat = m["cy"].between(0.44, 0.78) & m["wide"].between(1.4, 8.0) & m["bw"].between(0.012, 0.28) & (m["bh"] <= 0.18) & a.between(0.0007, 0.020) & ~edge
        role = (
            F.when((m["tall"] >= 2.0) & (a <= 0.008) & (m["cy"] < 0.92), "vertical")
            .when(boat, "boat")
            .when((m["cy"] > 0.58) & (m["wide"] >= 1.6) & (m["bh"] <= 0.22), "water")
            .when((m["cy"] < 0.80) & (a >= 0.0010) & (m["bh"] >= 0.055), "structure")
            .when((m["cy"] > 0.56) & (a <= 0.007) & (m["tall"] >= 1.15) & ~edge, "reflection")
            .when(accent & (a <= 0.0035) & (F.greatest(m["bw"], m["bh"]) <= 0.16) & (m["sat"] >= 0.35), "accent")
            .when((m["cy"] > 0.60) & (a <= 0.0035) & (m["lum"] < 0.34) & (m["sat"] < 0.85), "reflection")
            .otherwise("misc")
        )
    return d.withColumn("role", role).drop("_W", "_H")


def assign_semantics(regions: DataFrame, images: DataFrame, subject: bool = False) -> DataFrame:
    """Pseudo-semantic type and its confidence; needs ``role`` and ``solidity`` (area over hull area)."""
    # The limits, types and confidences in these rules, in their order.
    d, m = _shape(regions, images)
    a, role, solid = F.col("area_ratio"), F.col("role"), F.col("solidity")
    fill = F.least(F.lit(1.0), F.col("area") / F.greatest(F.lit(1.0), F.col("w") * F.col("h")))
    rules = [((role == "accent") | (F.col("is_accent") & (a < 0.004)), "accent", 0.84)]
    if subject:
        rules += [
            (a >= 0.015, "subject_mass", 0.82),
            ((m["tall"] >= 2.3) & (a >= 0.002), "elongated", 0.72),
            ((solid < 0.62) & (m["bh"] > 0.10), "subject_organic", 0.70),
            ((m["sat"] < 0.18) & (m["lum"] > 0.72), "light_surface", 0.66),
            (m["lum"] < 0.28, "dark_surface", 0.64),
            (F.lit(True), "subject_detail", 0.58),
        ]
    else:
        built = role == "structure"
        rules += [
            (role == "boat", "boat", 0.91),
            (role == "water", "water", 0.90),
            (role == "vertical", "elongated", 0.82),
            (role == "reflection", "reflection", 0.84),
            (built & (fill >= 0.72) & (m["wide"] >= 0.70), "building", 0.78),
            (built & (m["wide"] >= 1.7) & (m["bh"] < 0.14) & (m["cy"] > 0.32) & (m["cy"] < 0.72), "bridge", 0.68),
            (built & (solid < 0.70) & (m["cy"] < 0.58), "tree", 0.70),
            (built & (m["wide"] >= 1.25) & (m["bh"] < 0.18), "roof", 0.67),
            (built, "structure", 0.58),
            ((m["tall"] >= 2.5) & (a < 0.015), "elongated", 0.68),
            ((solid < 0.62) & (a >= 0.003), "organic", 0.62),
        ]
    kind, conf = F.lit("generic"), F.lit(0.4)
    for cond, name, value in reversed(rules):
        kind, conf = F.when(cond, name).otherwise(kind), F.when(cond, value).otherwise(conf)
    return d.withColumns({"semantic_type": kind, "semantic_confidence": conf}).drop("_W", "_H")


def assign_layers(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Composition layer by role and height in the picture."""
    # The heights that part layers.
    d, m = _shape(regions, images)
    role, y = F.col("role"), m["cy"]
    layer = (
        F.when(F.col("semantic_type").startswith("subject"), "midground")
        .when(role.isin("accent", "vertical"), "accents")
        .when(role.isin("water", "reflection"), "water")
        .when(role == "boat", "foreground")
        .when(role == "structure", F.when(y < 0.57, "skyline").otherwise("midground"))
        .when(y < 0.48, "skyline")
        .when(y > 0.68, "foreground")
        .otherwise("midground")
    )
    return d.withColumn("layer", layer).drop("_W", "_H")


def background_region(regions: DataFrame) -> DataFrame:
    """Per image the largest region at the canvas edge, else the largest; ties go to the smaller id."""
    rank = F.struct(F.col("touches_edge").cast("int").alias("e"), "area", (-F.col("region_id")).alias("i"))
    return regions.groupBy("image_id").agg(F.max_by("region_id", rank).alias("background_id"))


def score_importance(regions: DataFrame, palette: DataFrame, weights: dict[str, float], min_ratio: float, accent_repeat: int = 3) -> DataFrame:
    """Importance from area, contrast to the dominant color, rarity and structure; rescue of repeated accents.

    ``palette``: image_id, palette_id, ratio, r, g, b (a handful of rows per image); ``regions`` needs
    ``structure_score``. A color is rescued if it is saturated, rare, and at least ``accent_repeat`` of its
    regions have a size within a factor of four of their median; they become accents of at least 0.55.
    """
    p = palette.withColumn("lab", color.lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("p_sat", color.saturation(F.col("r"), F.col("g"), F.col("b")))
    top = p.groupBy("image_id").agg(F.max_by("lab", F.struct("ratio", (-F.col("palette_id")).alias("i"))).alias("dominant"))
    d = regions.join(p.select("image_id", "palette_id", F.col("ratio").alias("p_ratio"), "p_sat"), ["image_id", "palette_id"]).join(top, "image_id")
    image, group = W.partitionBy("image_id"), W.partitionBy("image_id", "palette_id")
    d = d.withColumns(
        {
            "area_score": F.least(F.lit(1.0), F.col("area_ratio") / F.greatest(F.max("area_ratio").over(image), F.lit(min_ratio))),
            "contrast_score": F.least(F.lit(1.0), color.delta_e76(color.lab(F.col("r"), F.col("g"), F.col("b")), F.col("dominant")) / 90.0),
            "rarity_score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(0.25) - F.col("p_ratio")) / 0.25)),
            "_median": F.percentile("area", F.lit(0.5)).over(group),
        }
    )
    total = sum((F.col(f"{n}_score") * w for n, w in weights.items()), F.lit(0.0))
    near = F.col("area").between(F.col("_median") * 0.25, F.col("_median") * 4.0) & (F.col("p_sat") >= 0.45) & (F.col("p_ratio") <= 0.20)
    d = d.withColumns({"importance": total, "_near": near})
    rescued = F.col("_near") & (F.sum(F.col("_near").cast("int")).over(group) >= accent_repeat)
    d = d.withColumn("_rescued", rescued)
    return d.withColumns({"is_accent": F.col("is_accent") | F.col("_rescued"), "importance": F.when(F.col("_rescued"), F.greatest(F.col("importance"), F.lit(0.55))).otherwise(F.col("importance"))}).drop("p_ratio", "p_sat", "dominant", "_median", "_near", "_rescued")


def keep_regions(regions: DataFrame, min_ratio: float, most: int) -> DataFrame:
    """Regions worth drawing, at most ``most`` per image, of which a quarter (4 to 12) is reserved for accents.

    Background regions are left out (``is_background``); reflections must be accents, important or large.
    """
    a, imp = F.col("area_ratio"), F.col("importance")
    reflection = F.col("role") == "reflection"
    keep = F.when(reflection, F.col("is_accent") | (imp >= 0.72) | (a >= min_ratio * 2)).otherwise((a >= min_ratio) | F.col("is_accent") | (imp >= 0.58))
    rows = regions.filter(~F.col("is_background") & keep)
    size = F.count("*").over(W.partitionBy("image_id"))
    limit = min(12, max(4, most // 4))
    accent = F.col("is_accent") | (F.col("role") == "vertical")
    by = W.partitionBy("image_id", accent).orderBy(F.desc("importance"), F.desc("area_ratio"), "region_id")
    rows = rows.withColumns({"_n": size, "_accent": accent & (F.row_number().over(by) <= limit)})
    order = [(F.col("role") == r).cast("int").desc() for r in ("structure", "boat", "water")]
    order += [(a >= min_ratio * 4).cast("int").desc(), imp.desc(), a.desc(), F.col("region_id")]
    place = F.row_number().over(W.partitionBy("image_id", "_accent").orderBy(*order))
    reserved = F.sum(F.col("_accent").cast("int")).over(W.partitionBy("image_id"))
    rows = rows.withColumns({"_place": place, "_room": F.lit(most) - reserved})
    return rows.filter((F.col("_n") <= most) | F.col("_accent") | (F.col("_place") <= F.col("_room"))).drop("_n", "_accent", "_place", "_room")


def thin_reflections(regions: DataFrame, most: int = 4) -> DataFrame:
    """All other regions, and of the ``most`` strongest reflections those that are important or large."""
    found = top_per_group(regions.filter("role = 'reflection'"), ["image_id"], [F.desc("importance"), F.desc("area_ratio")], most, ["region_id"], rank="_rank").drop("_rank")
    return regions.filter("role != 'reflection'").unionByName(found.filter("importance >= 0.48 or area_ratio >= 0.0025"))


def select_layers(regions: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Regions of each image by layer quota, with unused places filled by the best of the rest.

    Accents rank by being accent, vertical, importance, area; water by being water, area, importance; all
    others by being large, importance, area.
    """
    a, imp = F.col("area_ratio"), F.col("importance")
    layer = F.col("layer")
    k1 = F.when(layer == "accents", F.col("is_accent").cast("int")).when(layer == "water", (F.col("role") == "water").cast("int")).otherwise((a >= 0.006).cast("int"))
    k2 = F.when(layer == "accents", (F.col("role") == "vertical").cast("double")).when(layer == "water", a).otherwise(imp)
    k3 = F.when(layer == "accents", imp).when(layer == "water", imp).otherwise(a)
    big = F.col("semantic_type").isin("subject_mass", "subject_organic", "organic", "building", "boat").cast("int")
    fill = [(layer == "accents").cast("int").asc(), big.desc(), imp.desc(), a.desc()]
    return quota_with_backfill(regions, ["image_id"], "layer", quotas, [k1.desc(), k2.desc(), k3.desc(), a.desc()], fill, ["image_id", "region_id"])


def draw_order(regions: DataFrame) -> DataFrame:
    """``z`` of each region: by layer, then larger first, then less important later; ids break ties."""
    table = F.create_map(*[F.lit(x) for kv in LAYER_ORDER.items() for x in kv])
    rank = F.coalesce(F.try_element_at(table, F.col("layer")), F.lit(30))
    return regions.withColumn("z", F.row_number().over(W.partitionBy("image_id").orderBy(rank, F.desc("area_ratio"), F.desc("importance"), "region_id")) - 1)


def design_palette(palette: DataFrame, strength: float = 0.20, has_background: bool = True) -> DataFrame:
    """Role of each palette color and the color drawn toward its role's ratio-weighted mean (halves to even)."""
    c = F.col
    s, v = color.saturation(c("r"), c("g"), c("b")), F.greatest("r", "g", "b") / 255.0
    first = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("ratio"), "palette_id")) == 1
    p = palette.withColumn("_first", first)
    role = F.when(F.lit(has_background) & c("_first") & (c("ratio") >= 0.20), "background").when((s >= 0.58) & (c("ratio") <= 0.18), "accent").when(v <= 0.34, "dark").when((v >= 0.78) & (s <= 0.38), "light").otherwise("mid")
    p = p.withColumns({"role": role, "_w": F.greatest(c("ratio"), F.lit(0.001))})
    w = W.partitionBy("image_id", "role")
    t = F.lit(strength) * F.when(c("role") == "accent", 0.55).otherwise(1.0)
    out = {f"out_{n}": color.blend(c(n), F.bround(F.sum(c(n) * c("_w")).over(w) / F.sum("_w").over(w), 0), t) for n in "rgb"}
    return p.withColumns(out).drop("_first", "_w")


def aligned_patterns(regions: DataFrame, images: DataFrame, least: int = 3, tolerance: float = 0.05) -> DataFrame:
    """Rows and columns of equal palette colors: groups of at least ``least`` regions of one color whose centers
    line up within ``tolerance`` of the canvas, with their median spacing along the line."""
    d = regions.join(images.select("image_id", F.col("width").alias("_W"), F.col("height").alias("_H")), "image_id")
    both = d.select("image_id", "palette_id", "region_id", F.explode(F.array(F.struct(F.lit("horizontal").alias("axis"), F.col("cx").alias("at"), (F.col("cy") / F.col("_H")).alias("off")), F.struct(F.lit("vertical").alias("axis"), F.col("cy").alias("at"), (F.col("cx") / F.col("_W")).alias("off")))).alias("p")).select("image_id", "palette_id", "region_id", "p.*")
    key = ["image_id", "palette_id", "axis"]
    gaps = both.withColumn("gap", F.col("at") - F.lag("at").over(W.partitionBy(*key).orderBy("at", "region_id")))
    per = gaps.groupBy(*key).agg(F.count("*").alias("members"), (F.max("off") - F.min("off")).alias("drift"), F.median("gap").alias("spacing"), F.min("at").alias("start"))
    return per.filter((F.col("members") >= least) & (F.col("drift") <= tolerance))


def respace(regions: DataFrame, patterns: DataFrame) -> DataFrame:
    """New centers ``cx``, ``cy`` of pattern members: evenly spaced by the median from the first one."""
    key = ["image_id", "palette_id"]
    d = regions.join(patterns.select(*key, "axis", "spacing", "start"), key)
    along = F.when(F.col("axis") == "horizontal", F.col("cx")).otherwise(F.col("cy"))
    place = F.row_number().over(W.partitionBy(*key, "axis").orderBy(along, "region_id")) - 1
    d = d.withColumn("_at", F.col("start") + place * F.col("spacing"))
    return d.withColumns({"cx": F.when(F.col("axis") == "horizontal", F.col("_at")).otherwise(F.col("cx")), "cy": F.when(F.col("axis") == "vertical", F.col("_at")).otherwise(F.col("cy"))}).drop("_at", "spacing", "start")


def scene_quality(shapes: DataFrame, most: int, vertices_per_shape: float = 9.0) -> DataFrame:
    """Counts, tiny share and the clipped scores of each scene that need no raster; ``shapes``: image_id, kind,
    area, canvas_area, vertices, fill."""
    draw = F.col("kind") != "line"
    per = shapes.groupBy("image_id").agg(
        F.count("*").alias("shapes"),
        F.sum("vertices").alias("vertices"),
        F.count_distinct("fill").alias("colors"),
        F.coalesce(F.avg(F.when(draw, (F.col("area") / F.col("canvas_area") < 0.0012).cast("int"))), F.lit(0.0)).alias("tiny_share"),
    )
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return per.withColumns(
        {
            "minimality": clip(F.lit(1.05) - F.col("shapes") / max(1, most) * 0.45 - F.col("tiny_share") * 0.35),
            "complexity": clip(F.lit(1.0) - F.greatest(F.lit(0.0), F.col("vertices") / F.col("shapes") - vertices_per_shape) / 12.0),
            "palette": clip(F.lit(1.0) - F.greatest(F.lit(0), F.col("colors") - 8) / 12.0),
        }
    )


# ---- merge costs of touching regions

# Weights and scales of the merge cost, and the thresholds of its barriers.
MERGE_WEIGHTS = {"color": 0.30, "boundary": 0.25, "structure": 0.15, "topology": 0.10, "anchor": 0.10, "geometry": 0.10}
REDUNDANCY_WEIGHT, COLOR_TAU, NECK_TAU, HULL_TAU = 0.15, 25.0, 0.15, 0.25
SUBJECT_HIGH, SUBJECT_LOW, CONFIDENT, ALPHA_HARD, ANCHOR_SURE, MAX_COST = 0.80, 0.20, 0.80, 0.80, 0.80, 1.35


def merge_costs(edges: DataFrame, stats: DataFrame, image_area: Column) -> DataFrame:
    """First-round merge cost of every edge, its terms, and the barriers that forbid it (then the cost is null).

    ``edges``: image_id, a, b, shared_px, boundary_cost, alpha_share; ``stats``: image_id, region, n, l, ca, cb
    (mean Lab), perimeter_px, subject, confidence, anchor, anchor_confidence. The graph join is on
    (image, region); an image's hub region spreads over its edges' other ends.
    """
    s = stats.select("image_id", "region", F.struct(*[c for c in stats.columns if c not in ("image_id", "region")]).alias("s"))
    e = edges.join(s.withColumnsRenamed({"region": "a", "s": "p"}), ["image_id", "a"]).join(s.withColumnsRenamed({"region": "b", "s": "q"}), ["image_id", "b"])
    p, q = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"q.{c}"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    n = p("n") + q("n")
    d2 = sum((F.pow(p(c) - q(c), F.lit(2.0)) for c in ("l", "ca", "cb")), F.lit(0.0))
    shared = clip(F.col("shared_px") / F.greatest(F.lit(1e-12), F.least(p("perimeter_px"), q("perimeter_px")).cast("double")))
    differ = F.coalesce(p("anchor") != q("anchor"), F.lit(False))
    small = F.least(p("n"), q("n")) / image_area
    e = e.withColumns(
        {
            "color_cost": F.lit(1.0) - F.exp(-(p("n") * q("n") / n * d2 / n) / COLOR_TAU),
            "structure_cost": clip(F.abs(p("subject") - q("subject")) * F.least(p("confidence"), q("confidence"))),
            "topology_cost": clip(F.exp(-shared / NECK_TAU)),
            "anchor_cost": F.when(differ, clip(F.least(p("anchor_confidence"), q("anchor_confidence")) * F.least(F.lit(1.0), F.sqrt(d2) / 18.0))).otherwise(0.0),
            "protection": F.least(F.lit(0.35), F.least(F.lit(1.0), small / 0.03) * 0.20 + F.when(differ, F.greatest(p("anchor_confidence"), q("anchor_confidence"))).otherwise(0.0) * 0.15),
            "enclosure": F.least(F.lit(1.0), shared / 0.50),
            "smallness": F.exp(-small / 0.01),
        }
    )
    redundancy = clip(F.col("smallness") * (F.lit(1.0) - F.col("color_cost")) * (F.lit(1.0) - F.col("boundary_cost")) * F.col("enclosure"))
    sure = (p("confidence") >= CONFIDENT) & (q("confidence") >= CONFIDENT)
    split = ((p("subject") >= SUBJECT_HIGH) & (q("subject") <= SUBJECT_LOW)) | ((q("subject") >= SUBJECT_HIGH) & (p("subject") <= SUBJECT_LOW))
    barred = F.array_compact(
        F.array(
            F.when(sure & split, "subject_background"),
            F.when(F.col("alpha_share") >= ALPHA_HARD, "alpha"),
            F.when(differ & (p("anchor_confidence") >= ANCHOR_SURE) & (q("anchor_confidence") >= ANCHOR_SURE), "characteristic_anchor"),
        )
    )
    geometry = F.col("geometry_cost") if "geometry_cost" in edges.columns else F.lit(0.0)
    terms = {n_: (geometry if n_ == "geometry" else F.col(f"{n_}_cost")) for n_ in MERGE_WEIGHTS}
    total = sum((terms[n_] * w for n_, w in MERGE_WEIGHTS.items()), F.lit(0.0)) + F.col("protection") - redundancy * REDUNDANCY_WEIGHT
    e = e.withColumns({"redundancy": redundancy, "blocked_by": barred})
    cost = F.when(F.size("blocked_by") == 0, F.least(F.lit(MAX_COST), F.greatest(F.lit(0.0), total)))
    return e.withColumn("cost", cost).drop("p", "q", "enclosure", "smallness")
