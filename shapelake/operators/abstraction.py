"""Region decisions of the abstraction: backdrop, similar regions, robust colors, palette relations, importance,
part geometry, relation checks, and the predicates and scores of merging and simplifying.

Region rows are those of ``operators.regions``. What depends on an order within one image (greedy merging,
splitting a palette) is a function of that image's rows; all else is joins, windows and aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import color
from shapelake.operators.ranking import even_sample

# ---- backdrop

# What a frame or ring is, and what a broad pale mass at the top is.
RING = {"box": 0.84, "area": 0.10, "filled": 0.22}
SKY = {"area": 0.12, "width": 0.62, "top": 0.18, "center": 0.42, "saturation": 0.24, "near": 0.04, "near_px": 16.0, "by_width": 0.15, "by_saturation": 0.10}


def backdrop(regions: DataFrame, images: DataFrame, touching: DataFrame, ring: dict[str, float] = RING, sky: dict[str, float] = SKY) -> DataFrame:
    """Regions that act as backdrop: image_id, region_id, why ('primary', 'ring', 'sky'; the first that holds).

    ``regions`` needs ``background_id`` (the image's primary background, may be null) and ``outer_area`` (area
    inside the outer contour); ``touching``: image_id, a, b, regions that come within three pixels. Of broad pale
    masses at the top only the best of an image counts (ties: the smaller id).
    """
    size = images.select("image_id", F.col("width").cast("double").alias("_W"), F.col("height").cast("double").alias("_H"))
    d = regions.join(size, "image_id")
    sat = color.saturation(F.col("r"), F.col("g"), F.col("b"))
    primary = F.coalesce(F.col("region_id") == F.col("background_id"), F.lit(False))
    bw, bh = F.col("w") / F.col("_W"), F.col("h") / F.col("_H")
    framed = (bw >= ring["box"]) & (bh >= ring["box"]) & (F.col("area_ratio") <= ring["area"]) & (F.col("area") / F.greatest(F.col("outer_area").cast("double"), F.lit(1.0)) < ring["filled"])
    both = touching.select("image_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    beside = both.join(regions.select("image_id", "background_id").distinct(), "image_id").filter("p.a = background_id").select("image_id", F.col("p.b").alias("region_id"), F.lit(True).alias("_beside")).distinct()
    near = F.col("y") <= F.greatest(F.lit(sky["near_px"]), F.floor(F.col("_H") * sky["near"]))
    pale = (
        ~primary & (F.col("area_ratio") >= sky["area"]) & (bw >= sky["width"]) & (F.col("y") / F.col("_H") <= sky["top"]) & (F.col("cy") / F.col("_H") <= sky["center"])
        & (sat <= sky["saturation"]) & (F.coalesce("_beside", F.lit(False)) | near)
    )
    score = F.when(pale, F.col("area_ratio") + bw * sky["by_width"] - sat * sky["by_saturation"])
    d = d.join(beside, ["image_id", "region_id"], "left").withColumns({"_primary": primary, "_ring": framed, "_score": score})
    best = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc_nulls_last("_score"), "region_id"))
    why = F.when(F.col("_primary"), "primary").when(F.col("_ring"), "ring").when(F.col("_score").isNotNull() & (F.col("_best") == 1), "sky")
    return d.withColumn("_best", best).select("image_id", "region_id", why.alias("why")).filter("why is not null")


def background_color(mode: Column, source: Column, custom: Column) -> Column:
    """Color behind a scene: none if transparent, white, the custom color, else the source region's if there is one."""
    white = F.struct(*[F.lit(255).alias(c) for c in "rgb"])
    return F.when(mode == "transparent", F.lit(None)).when(mode == "white", white).when(mode == "custom", custom).otherwise(F.coalesce(source, custom))


# Where a horizon can be, where its evidence is looked for, and where it is without any.
HORIZON = {"low": 0.48, "high": 0.70, "water": (0.38, 0.78), "ground": (0.40, 0.78), "default": 0.58}


def horizon(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Height of each image's horizon: the median top of water and boats near the middle, else the median foot of
    structures, else a usual height (image_id, horizon_y)."""
    d = images.join(regions.select("image_id", "role", "y", "h"), "image_id", "left")
    y, foot, tall = F.col("y").cast("double"), (F.col("y") + F.col("h")).cast("double"), F.col("height")
    near = lambda c, k: c.between(tall * HORIZON[k][0], tall * HORIZON[k][1])
    per = d.groupBy("image_id", tall.alias("_H")).agg(F.median(F.when(F.col("role").isin("water", "boat") & near(y, "water"), y)).alias("_w"), F.median(F.when((F.col("role") == "structure") & near(foot, "ground"), foot)).alias("_g"))
    found = F.least(F.greatest(F.coalesce("_w", "_g"), F.col("_H") * HORIZON["low"]), F.col("_H") * HORIZON["high"])
    return per.select("image_id", F.coalesce(F.when(F.coalesce("_w", "_g").isNotNull(), found), F.col("_H") * HORIZON["default"]).alias("horizon_y"))


# ---- similar regions


def similar_pairs(regions: DataFrame, touching: DataFrame, delta_e: float) -> DataFrame:
    """Touching regions of an image whose colors are within ``delta_e``: image_id, a, b."""
    lab = regions.select("image_id", "region_id", color.lab(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    p = touching.join(lab.withColumnsRenamed({"region_id": "a", "lab": "p"}), ["image_id", "a"]).join(lab.withColumnsRenamed({"region_id": "b", "lab": "q"}), ["image_id", "b"])
    return p.filter(color.delta_e76(F.col("p"), F.col("q")) <= delta_e).select("image_id", "a", "b").distinct()


def merge_similar(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which region each one joins: image_id, region_id, target. In the order of ids, a region not yet taken takes
    all later ones it is paired with that aren't taken either; nobody is taken through another. The order is the
    semantics, so an image's pairs go through one task, as rows of regions, not of pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        later: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            if a != b:
                later.setdefault(min(a, b), []).append(max(a, b))
        target: dict[int, int] = {}
        for a in sorted(later):
            if target.get(a, a) == a:
                for b in later[a]:
                    if b not in target:
                        target[b] = a
                target[a] = a
        rows = [(pdf["image_id"].iat[0], r, t) for r, t in target.items() if r != t]
        return pd.DataFrame(rows, columns=["image_id", "region_id", "target"])

    kind, key = (pairs.schema[c].dataType.simpleString() for c in ("a", "image_id"))
    taken = pairs.groupBy("image_id").applyInPandas(run, f"image_id {key}, region_id {kind}, target {kind}")
    return regions.select("image_id", "region_id").join(taken, ["image_id", "region_id"], "left").withColumn("target", F.coalesce("target", "region_id"))


def merged_regions(regions: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per merged region: areas added, colors and centers weighted by area, boxes united, the greatest
    importance, accent or edge if any member is."""
    d = regions.join(targets, ["image_id", "region_id"])
    weight = lambda c: F.sum(F.col(c) * F.col("area")) / F.sum("area")
    box = {"x": F.min("x"), "y": F.min("y"), "_x1": F.max(F.col("x") + F.col("w")), "_y1": F.max(F.col("y") + F.col("h"))}
    aggs = [F.sum("area").alias("area"), F.sum("area_ratio").alias("area_ratio"), weight("cx").alias("cx"), weight("cy").alias("cy"), *[F.round(weight(c)).cast("int").alias(c) for c in "rgb"], *[v.alias(k) for k, v in box.items()]]
    aggs += [F.max(c).alias(c) for c in ("importance", "is_accent", "touches_edge") if c in regions.columns] + [F.count("*").alias("members")]
    out = d.groupBy("image_id", F.col("target").alias("region_id")).agg(*aggs)
    return out.withColumns({"w": F.col("_x1") - F.col("x"), "h": F.col("_y1") - F.col("y")}).drop("_x1", "_y1")


# ---- robust colors and relations of palette colors


def robust_medoid(pixels: DataFrame, samples: int = 1024, candidates: int = 64) -> DataFrame:
    """The pixel that stands best for its region's color: image_id, region, place, r, g, b, lab, pixel_count.

    ``pixels``: image_id, region, place (order within the image), r, g, b. Of evenly spaced samples of a region the
    ``candidates`` nearest to the median of each Lab channel are tried; the one with the least sum of CIEDE2000
    differences to all samples wins (ties: nearer to the median, then earlier). Work per region is bounded by
    ``samples`` times ``candidates``; counts are of all pixels.
    """
    key = ["image_id", "region"]
    s = even_sample(pixels.select(*key, "place", "r", "g", "b"), key, ["place"], samples).withColumn("lab", color.lab(F.col("r"), F.col("g"), F.col("b")))
    mid = s.groupBy(*key).agg(*[F.median(f"lab.{c}").alias(f"_{c}") for c in "lab"])
    far = F.round(F.sqrt(sum((F.pow(F.col(f"lab.{c}") - F.col(f"_{c}"), F.lit(2.0)) for c in "lab"), F.lit(0.0))), 9)
    near = s.join(mid, key).withColumn("_far", far).withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy("_far", "place"))).filter(F.col("_k") <= candidates)
    pairs = near.select(*key, "_k", "place", "r", "g", "b", F.col("lab").alias("p")).join(s.select(*key, F.col("lab").alias("q")), key)
    total = color.with_delta_e2000(pairs, "p", "q", "_d").groupBy(*key, "_k").agg(F.round(F.sum("_d"), 6).alias("_d"), *[F.first(c).alias(c) for c in ("place", "r", "g", "b", "p")])
    best = total.groupBy(*key).agg(F.min(F.struct("_d", "_k", "place", "r", "g", "b", "p")).alias("m"))
    count = pixels.groupBy(*key).agg(F.count("*").alias("pixel_count"))
    return best.join(count, key).select(*key, "m.place", "m.r", "m.g", "m.b", F.col("m.p").alias("lab"), "pixel_count")


def region_samples(pixels: DataFrame, sizes: DataFrame, anchors: DataFrame | None = None, reach: float = 18.0, **medoid) -> DataFrame:
    """Color sample of each region: its robust medoid, its share of the image, and the anchors (image_id, anchor_id,
    lab, confidence) whose color is within ``reach`` (CIEDE2000)."""
    m = robust_medoid(pixels, **medoid).join(sizes.select("image_id", F.col("pixels").alias("_n")), "image_id").withColumn("share", F.col("pixel_count") / F.col("_n")).drop("_n")
    if anchors is None:
        return m.withColumn("anchor_ids", F.array().cast("array<int>"))
    near = color.with_delta_e2000(m.select("image_id", "region", F.col("lab").alias("p")).join(anchors.select("image_id", "anchor_id", F.col("lab").alias("q")), "image_id"), "p", "q", "_d").filter(F.col("_d") <= reach)
    near = near.groupBy("image_id", "region").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchor_ids"))
    return m.join(near, ["image_id", "region"], "left").withColumn("anchor_ids", F.coalesce("anchor_ids", F.array().cast("array<int>")))


# Protection of a relation by its reason.
PROTECTION = {"adjacent_major": 0.80, "major_mass": 0.75, "semantic_boundary": 0.90, "characteristic_boundary": 1.0, "subject_background": 1.0, "characteristic_anchor": 1.0}


def palette_relations(samples: DataFrame, edges: DataFrame, major: float = 0.03, contrast: float = 12.0) -> DataFrame:
    """Color relations to keep between regions: image_id, a, b (a < b), delta_e, delta_l, protection, reasons.

    ``samples``: image_id, region, lab, share; ``edges``: image_id, a, b, reasons (array; what is known of the
    boundary). Neighbours that are both major (by share) relate, and neighbours with a known reason; major regions of
    an image, of which there are at most 1 / ``major``, also relate when they contrast. The protection of a relation
    is that of its strongest reason.
    """
    one = samples.select("image_id", F.col("region").alias("a"), F.col("lab").alias("p"), (F.col("share") >= major).alias("ma"))
    two = samples.select("image_id", F.col("region").alias("b"), F.col("lab").alias("q"), (F.col("share") >= major).alias("mb"))
    e = edges.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")).filter("a != b")
    e = e.groupBy("image_id", "a", "b").agg(F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("known")).withColumn("next", F.lit(True))
    big = one.filter("ma").join(two.filter("mb"), "image_id").filter("a < b").select("image_id", "a", "b", F.lit(True).alias("both"))
    d = e.join(big, ["image_id", "a", "b"], "full").join(one, ["image_id", "a"]).join(two, ["image_id", "b"])
    d = color.with_delta_e2000(d, "p", "q", "delta_e")
    new = F.array_compact(F.array(F.when(F.col("next") & F.col("ma") & F.col("mb"), "adjacent_major"), F.when(F.col("both") & (F.col("delta_e") >= contrast), "major_mass")))
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("known", F.array().cast("array<string>")), new)))
    table = F.create_map(*[F.lit(x) for kv in PROTECTION.items() for x in kv])
    d = d.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return d.select("image_id", "a", "b", "delta_e", (F.col("p.l") - F.col("q.l")).alias("delta_l"), F.array_max(F.transform("reasons", lambda x: F.coalesce(F.try_element_at(table, x), F.lit(0.0)))).alias("protection"), "reasons")


def repair_relations(selected: set[int], children: dict[int, tuple[int, int]], leaves: dict[int, set[int]], relations: list[tuple[int, int]], broken, error) -> tuple[set[int], int]:
    """Split nodes of a palette hierarchy until no relation between regions is broken, and how many splits it took.

    ``selected`` nodes cover the regions in ``leaves``; ``broken(a, b, node_a, node_b)`` judges a relation under the
    present cover. A relation inside one node splits it; else the splittable side with the greater ``error(region,
    node)`` is split (ties: the smaller node). Every split refines the cover, so it ends; a broken relation that no
    split can mend raises.
    """
    cover, splits = set(selected), 0
    while True:
        node_of = {r: n for n in cover for r in leaves[n]}
        bad = next(((a, b) for a, b in relations if broken(a, b, node_of[a], node_of[b])), None)
        if bad is None:
            return cover, splits
        sides = {node_of[r]: error(r, node_of[r]) for r in bad if node_of[r] in children}
        if not sides:
            raise ValueError(f"no split can mend the relation of {bad[0]} and {bad[1]}")
        node = min(sides, key=lambda n: (-sides[n], n))
        cover = (cover - {node}) | set(children[node])
        splits += 1


# ---- importance of shapes under a detail budget

# Weights of the importance and the limits above which a shape is protected.
SHAPE_WEIGHTS = {"area": 0.25, "structural": 0.20, "characteristic": 0.20, "contrast": 0.15, "semantic": 0.10, "pose": 0.10}
STRUCTURAL_MASS, SILHOUETTE, POSE = 0.04, 0.30, 0.80


def shape_importance(shapes: DataFrame) -> DataFrame:
    """Importance of each shape and why it is protected.

    ``shapes``: image_id, region_id, share, silhouette, protected_boundary, contrast, semantic, pose (0 to 1, null as
    0), critical (boolean), anchor_ids. A shape is the last support of an anchor if no other of its image has it.
    Output adds importance and protection_reasons.
    """
    key = ["image_id", "region_id"]
    a = shapes.select(*key, F.explode("anchor_ids").alias("anchor"))
    last = a.withColumn("n", F.count("*").over(W.partitionBy("image_id", "anchor"))).groupBy(*key).agg((F.min("n") <= 1).alias("last"))
    d = shapes.join(last, key, "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    mass = F.least(F.lit(1.0), z("share") / STRUCTURAL_MASS)
    parts = {
        "area": F.sqrt(mass),
        "structural": unit(F.greatest(mass, z("silhouette"), z("protected_boundary"))),
        "characteristic": (F.size("anchor_ids") > 0).cast("double"),
        "contrast": z("contrast"),
        "semantic": z("semantic"),
        "pose": z("pose"),
    }
    total = sum((parts[n] * w for n, w in SHAPE_WEIGHTS.items()), F.lit(0.0))
    why = F.array_compact(
        F.array(
            F.when(z("share") >= STRUCTURAL_MASS, "structural_mass"),
            F.when(z("silhouette") >= SILHOUETTE, "silhouette_contributor"),
            F.when(z("pose") >= POSE, "pose_structure"),
            F.when(F.coalesce("critical", F.lit(False)), "critical_semantic"),
            F.when(F.coalesce("last", F.lit(False)), "last_characteristic_support"),
        )
    )
    return d.withColumns({"importance": unit(total), "protection_reasons": why}).drop("last")


def anchor_support(shapes: DataFrame, entries: DataFrame) -> DataFrame:
    """Per anchor the shapes that carry it in a color that stands for it: image_id, anchor_id, support.
    ``entries``: image_id, palette_id, anchor_ids of the palette."""
    s = shapes.select("image_id", "palette_id", F.explode("anchor_ids").alias("anchor_id"))
    e = entries.select("image_id", "palette_id", F.explode("anchor_ids").alias("anchor_id")).distinct()
    return s.join(e, ["image_id", "palette_id", "anchor_id"]).groupBy("image_id", "anchor_id").agg(F.count("*").alias("support"))


# ---- predicates of merging and simplifying

# Limits of a safe merge and of a simplified contour.
SAFE = {"area": 0.0008, "color_cost": 0.08, "boundary_cost": 0.15, "structure_cost": 0.05, "anchor_cost": 0.05, "topology_cost": 0.25, "protection": 0.02}
SAFE_SHARED = 0.35
GUARDS = {"area_change": 0.08, "centroid_shift": 0.04}
GUARD_IOU = 0.90


def safe_merge(area_share: Column, allowed: Column, costs: dict[str, Column], shared: Column) -> Column:
    """Whether two regions can be merged without further ado: the merge is allowed, the smaller is small, every cost
    is low, and they share enough boundary. A null cost is not safe."""
    ok = F.coalesce(allowed, F.lit(False)) & (area_share <= SAFE["area"]) & (shared >= SAFE_SHARED)
    for name, c in costs.items():
        ok = ok & (c <= SAFE[name])
    return F.coalesce(ok, F.lit(False))


def contour_ok(valid: Column, area_change: Column, iou: Column, centroid_shift: Column, directional: Column, limit: Column) -> Column:
    """Whether a simplified contour may replace its original."""
    return F.coalesce(valid & (area_change <= GUARDS["area_change"]) & (iou >= GUARD_IOU) & (centroid_shift <= GUARDS["centroid_shift"]) & (directional <= limit), F.lit(False))


# What visual and structural roles count for, and where policies begin.
VISUAL = {"silhouette": 0.45, "identity_accent": 0.40, "major_mass": 0.30, "internal_detail": 0.05}
STRUCTURAL = {"root": 0.30, "body": 0.30, "connector": 0.30, "attached": 0.15}
TOPOLOGY, CONFIDENCE, PRESERVE_FROM, SIMPLIFY_FROM = 0.15, 0.10, 0.70, 0.25


def part_importance(category: Column, visual: Column, structural: Column, constrained: Column, confidence: Column) -> Column:
    """Importance of a semantic part, 0 to 1 to six digits; details of a face have none."""
    get = lambda t, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), c), F.lit(0.0))
    score = get(VISUAL, visual) + get(STRUCTURAL, structural) + F.when(constrained, TOPOLOGY).otherwise(0.0) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0)))) * CONFIDENCE
    return F.when((category == "face") & (visual == "internal_detail"), F.lit(0.0)).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def part_policy(category: Column, visual: Column, structural: Column, importance: Column) -> Column:
    """What becomes of a part: suppress, preserve, simplify or conditional, by the first rule that holds."""
    return (
        F.when((category == "face") & (visual == "internal_detail"), "suppress")
        .when(visual == "identity_accent", "preserve")
        .when(structural.isin("body", "connector"), "simplify")
        .when((category == "unknown") | (structural == "unknown"), "conditional")
        .when(importance >= PRESERVE_FROM, "preserve")
        .when(importance >= SIMPLIFY_FROM, "simplify")
        .otherwise("conditional")
    )


# ---- parts and their relations


def part_colors(pixels: DataFrame) -> DataFrame:
    """Mean color of each part's pixels (image_id, part, r, g, b)."""
    return pixels.filter("part is not null").groupBy("image_id", "part").agg(*[F.avg(c).alias(c) for c in "rgb"], F.count("*").alias("pixels"))


def part_geometry(pixels: DataFrame) -> DataFrame:
    """Center and box diagonal of each part's pixels (image_id, part, x, y)."""
    wide, high = F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1
    return pixels.filter("part is not null").groupBy("image_id", "part").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.hypot(wide.cast("double"), high.cast("double")).alias("diagonal"))


def component_index(components: DataFrame, key: list[str], area: str, order: list[str]) -> DataFrame:
    """Number of each component within its role from 0, largest first (ties by ``order``)."""
    return components.withColumn("component_index", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(area), *order)) - 1)


def relation_lookup(relations: DataFrame) -> DataFrame:
    """Relations by both of their ends: case_id, part, others (array of other, relation, forward), sorted."""
    way = lambda a, b, forward: F.struct(F.col(a).alias("part"), F.col(b).alias("other"), F.col("relation").alias("relation"), F.lit(forward).alias("forward"))
    rows = relations.select("case_id", F.explode(F.array(way("a", "b", True), way("b", "a", False))).alias("r")).select("case_id", "r.*").distinct()
    return rows.groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct("other", "relation", "forward"))).alias("others"))


def one_sided(adjacency: DataFrame) -> DataFrame:
    """Adjacencies (image_id, a, b) that the other end doesn't know, or of a region with itself."""
    back = adjacency.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    lonely = adjacency.join(back, ["image_id", "a", "b"], "left_anti").withColumn("why", F.lit("one_sided"))
    return lonely.unionByName(adjacency.filter("a = b").withColumn("why", F.lit("self"))).distinct()


def counts_by(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """How often each value of each column occurs (key, name, value, n), in one pass; null is a value of its own."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    return rows.select(*key, F.explode(each).alias("e")).groupBy(*key, "e.name", "e.value").agg(F.count("*").alias("n"))
