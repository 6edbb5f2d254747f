"""Shape tables: neighbours through a grid, global value and pruning, isolated fragments, slivers, calibration.

shapes: image_id, shape_id, layer, box array<double>, area, aspect, vertices, importance, r, g, b, protected;
canvas: image_id, width, height, bg_r, bg_g, bg_b (null: no background).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import geometry
from shapelake.operators.evidence import COST_WEIGHTS
from shapelake.operators.ranking import best_per_group

# Weights of the seven terms of a shape's value.
VALUE_WEIGHTS = {"area": 0.23, "importance": 0.25, "contrast": 0.18, "silhouette": 0.12, "uniqueness": 0.10, "connectedness": 0.07, "simplicity": 0.05}


def near_pairs(shapes: DataFrame, reach: Column, keep: list[str]) -> DataFrame:
    """Ordered pairs (p, q) of different shapes of one layer whose boxes are within ``reach`` (a column, one value
    per image), with structs of the columns ``keep``.

    Boxes grown by half the reach enter grid cells and meet only boxes of the same image, layer and cell; each
    pair comes out in one cell, that of the corner of the grown boxes' intersection. A pile of n shapes on one
    spot still has n^2 pairs: they are the answer there, and a scene's budget bounds n.
    """
    s = shapes.withColumn("_reach", reach)
    b, half = F.col("box"), F.col("_reach") / 2.0
    s = s.withColumn("_g", F.array(b[0] - half, b[1] - half, b[2] + F.col("_reach"), b[3] + F.col("_reach")))
    side = F.greatest(F.lit(1.0), F.max(F.greatest(F.col("_g")[2], F.col("_g")[3])).over(W.partitionBy("image_id")) / 8.0)
    s = s.withColumn("_c", side)
    g = F.col("_g")
    span = lambda i: F.sequence(F.floor(g[i] / F.col("_c")).cast("int"), F.floor((g[i] + g[i + 2]) / F.col("_c")).cast("int"))
    cells = s.select("image_id", "layer", "shape_id", "_g", "_c", "_reach", F.struct("shape_id", "box", *keep).alias("s"), F.explode(span(0)).alias("gx"), span(1).alias("_ys")).withColumn("gy", F.explode("_ys")).drop("_ys")
    p, q = cells.alias("p"), cells.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("image_id", "layer", "gx", "gy")]
    home = lambda i, c: F.floor(F.greatest(F.col("p._g")[i], F.col("q._g")[i]) / F.col("p._c")) == F.col(f"p.{c}")
    j = p.join(q, [*same, F.col("p.shape_id") != F.col("q.shape_id")]).filter(home(0, "gx") & home(1, "gy"))
    return j.select(F.col("p.image_id").alias("image_id"), F.col("p.s").alias("p"), F.col("q.s").alias("q"), F.col("p._reach").alias("reach"))


def box_distance(a: Column, b: Column) -> Column:
    """Distance of two boxes, 0 if they meet."""
    dx = F.greatest(F.lit(0.0), F.greatest(a[0], b[0]) - F.least(a[0] + a[2], b[0] + b[2]))
    dy = F.greatest(F.lit(0.0), F.greatest(a[1], b[1]) - F.least(a[1] + a[3], b[1] + b[3]))
    return F.hypot(dx, dy)


def global_value(shapes: DataFrame, canvas: DataFrame, least: float = 0.400, small: float = 0.006, unimportant: float = 0.64, reach_ratio: float = 0.035, overlap: float = 0.82, alike: float = 16.0) -> DataFrame:
    """Seven scores in 0..1, their weighted value, and action and reason for every shape.

    Removed are unprotected small unimportant shapes of low value, and fragments of the background's color off the
    border; strong contrast rescues. Only neighbours within reach count for connectedness, and only overlapping
    ones of like color for redundancy, so pairs come from a grid.
    """
    # Weights and scales of the terms below.
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    d = shapes.join(canvas, "image_id")
    reach = F.least("width", "height") * reach_ratio
    pairs = near_pairs(d, reach, ["r", "g", "b"])
    cd = F.sqrt(sum((F.pow((F.col(f"p.{c}") - F.col(f"q.{c}")).cast("double"), F.lit(2.0)) for c in "rgb"), F.lit(0.0)))
    ov = geometry.box_overlap(F.col("p.box"), F.col("q.box"))
    near = pairs.groupBy("image_id", F.col("p.shape_id").alias("shape_id")).agg(F.min(box_distance(F.col("p.box"), F.col("q.box"))).alias("_near"), F.max(F.when((cd <= alike) & (ov >= overlap), ov)).alias("_ov"))
    d = d.join(near, ["image_id", "shape_id"], "left").withColumn("_reach", reach)
    b, ar = F.col("box"), F.col("area") / (F.col("width") * F.col("height"))
    to_bg = F.sqrt(sum((F.pow((F.col(c) - F.col(f"bg_{c}")).cast("double"), F.lit(2.0)) for c in "rgb"), F.lit(0.0)))
    d = d.withColumns({"area_ratio": ar, "_bg": to_bg, "_edge": (b[0] <= 1.5) | (b[1] <= 1.5) | (b[0] + b[2] >= F.col("width") - 1.5) | (b[1] + b[3] >= F.col("height") - 1.5), "_area": clip(F.sqrt(ar / 0.018)), "_imp": clip(F.col("importance"))})
    d = d.withColumns(
        {
            "contrast": F.coalesce(clip(F.col("_bg") / 150.0), F.lit(0.55)),
            "silhouette": clip(F.col("_area") * 0.45 + 0.35 + F.when(F.col("_edge"), 0.20).otherwise(0.0)),
            "connectedness": F.coalesce(clip(F.lit(1.0) - F.col("_near") / F.greatest(F.col("_reach"), F.lit(1e-6))), F.lit(0.0)),
            "uniqueness": clip(F.lit(1.0) - F.coalesce("_ov", F.lit(0.0))),
            "simplicity": clip(F.lit(1.0) - clip((F.col("aspect") - 5.0) / 8.0) * 0.55 - clip((F.col("vertices") - 7) / 12.0) * 0.45),
        }
    )
    names = {"area": "_area", "importance": "_imp"}
    d = d.withColumn("value", sum((F.col(names.get(n, n)) * w for n, w in VALUE_WEIGHTS.items()), F.lit(0.0)))
    low = ~F.col("protected") & (F.col("area_ratio") <= small) & (F.col("_imp") <= unimportant) & (F.col("value") < least)
    like = F.coalesce(~F.col("protected") & ~F.col("_edge") & (F.col("area_ratio") <= 0.007) & (F.col("_imp") <= 0.40) & (F.col("_bg") <= 12.0), F.lit(False))
    rescue = (F.col("contrast") >= 0.76) & (F.col("area_ratio") >= 0.00012)
    reason = F.when(~rescue & low, "low_global_value").when(~rescue & like, "near_background_fragment").when(F.col("protected"), "protected_semantic").otherwise("sufficient_value")
    d = d.withColumn("reason", reason)
    action = F.when(F.col("reason").isin("low_global_value", "near_background_fragment"), "remove").otherwise("keep")
    return d.select("image_id", "shape_id", "area_ratio", "contrast", "silhouette", "uniqueness", "connectedness", "simplicity", "value", action.alias("action"), "reason")


def isolated(shapes: DataFrame, reach: Column) -> DataFrame:
    """Shapes without another one of their layer within ``reach``."""
    near = near_pairs(shapes, reach, []).filter(box_distance(F.col("p.box"), F.col("q.box")) <= F.col("reach"))
    return shapes.join(near.select("image_id", F.col("p.shape_id").alias("shape_id")).distinct(), ["image_id", "shape_id"], "left_anti")


def sliver_reason(kind: Column, short: Column, long: Column, area_ratio: Column, thin: float = 2.0, aspect: float = 9.0, micro: float = 0.00008) -> Column:
    """Why a shape is a sliver: 'micro', 'thin_rectangle', 'thin', or null."""
    long_enough = long / F.greatest(short, F.lit(1e-6)) >= aspect
    return F.when(area_ratio <= micro, "micro").when((short <= thin) & (kind == "rectangle"), "thin_rectangle").when((short <= thin) & long_enough, "thin")


def calibrate(candidates: DataFrame, policies: list[dict[str, float]], targets: dict[str, float]) -> DataFrame:
    """Loss of every policy (cost weights by name) on the candidates it would choose, best first: mean squared
    distance of the chosen metrics' means to ``targets``, to twelve digits; ties by policy number.

    ``candidates``: scene_id, region_id, candidate_id and the metrics of ``COST_WEIGHTS``-named costs plus those
    named in ``targets``. The few policies ride along as an array of literals; candidates are read once.
    """
    names = list(COST_WEIGHTS)
    grid = F.array(*[F.struct(F.lit(i).alias("policy"), *[F.lit(float(p.get(n, COST_WEIGHTS[n]))).alias(n) for n in names]) for i, p in enumerate(policies)])
    c = candidates.withColumn("_p", F.explode(grid)).withColumn("policy", F.col("_p.policy"))
    score = sum((F.col(n) * F.col(f"_p.{n}") for n in names), F.lit(0.0))
    extra = [t for t in targets if t not in ("scene_id", "region_id")]
    chosen = best_per_group(c, ["policy", "scene_id", "region_id"], score, "candidate_id", extra)
    means = chosen.groupBy("policy").agg(F.count("*").alias("chosen"), *[F.avg(t).alias(t) for t in extra])
    loss = sum((F.pow(F.col(t) - v, F.lit(2.0)) for t, v in targets.items()), F.lit(0.0)) / max(1, len(targets))
    return means.withColumn("loss", F.round(loss, 12)).withColumn("rank", F.row_number().over(W.orderBy("loss", "policy")))


def perceptual_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Regions under a global budget: one major per part is safe, a quarter of the budget is reserved for accents,
    the rest goes by rank (majors, accents, minors; then score) with a cap per part.

    ``rows``: image_id, part, region_id, score, major, accent. A part's cap counts only its own regions, so who
    passes it follows from ranks within the part, and the budget from a rank over all that pass.
    """
    image = W.partitionBy("image_id")
    order = [F.desc("score"), F.col("part"), F.col("region_id")]
    kind = F.when(F.col("major"), 0).when(F.col("accent"), 1).otherwise(2)
    d = rows.withColumns({"_k": kind, "_parts": F.size(F.collect_set("part").over(image)), "_acc": F.sum((kind == 1).cast("int")).over(image)})
    d = d.withColumn("_slots", F.least(F.lit(max(1, budget // 4)), F.col("_acc")) if budget >= 4 else F.lit(0))
    first = (F.col("_k") == 0) & (F.row_number().over(W.partitionBy("image_id", "part", "_k").orderBy(*order)) == 1)
    d = d.withColumn("_safe", first)
    safe_rank = F.row_number().over(W.partitionBy("image_id", "_safe").orderBy(*order))
    d = d.withColumn("_g", F.col("_safe") & (safe_rank <= F.lit(budget) - F.col("_slots")))
    acc_rank = F.row_number().over(W.partitionBy("image_id", "_k").orderBy(*order))
    d = d.withColumn("_a", (F.col("_k") == 1) & (acc_rank <= F.col("_slots")) & (acc_rank <= F.lit(budget) - F.sum(F.col("_g").cast("int")).over(image)))
    d = d.withColumns({"_in": F.col("_g") | F.col("_a"), "_cap": F.greatest(F.lit(2), F.ceil(F.lit(budget) / F.col("_parts")).cast("int") + 1)})
    mine = F.sum(F.col("_in").cast("int")).over(W.partitionBy("image_id", "part"))
    place = F.row_number().over(W.partitionBy("image_id", "part", "_in").orderBy("_k", *order))
    d = d.withColumn("_ok", ~F.col("_in") & (mine + place <= F.col("_cap")))
    left = F.lit(budget) - F.sum(F.col("_in").cast("int")).over(image)
    late = F.row_number().over(W.partitionBy("image_id", "_ok").orderBy("_k", *order))
    d = d.withColumns({"_left": left, "_late": late})
    return d.filter(F.col("_in") | (F.col("_ok") & (F.col("_late") <= F.col("_left")))).select(*rows.columns, F.when(F.col("_g"), "guaranteed").when(F.col("_a"), "accent").otherwise("ranked").alias("picked"))


def phase_profile(timings: DataFrame) -> DataFrame:
    """Mean seconds of each phase over the repeats, and its share of the sum; ``timings``: run_id, repeat, phase, seconds."""
    per = timings.groupBy("run_id", "phase").agg(F.avg("seconds").alias("mean_seconds"))
    return per.withColumn("share", F.coalesce(F.try_divide(F.col("mean_seconds"), F.sum("mean_seconds").over(W.partitionBy("run_id"))), F.lit(0.0)))


def within_budget(measured: DataFrame, key: list[str], limits: dict[str, float]) -> DataFrame:
    """Measurements against their limits: names of those exceeded (a missing value exceeds), and whether none is."""
    over = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n) <= v, F.lit(False)), F.lit(n)) for n, v in limits.items()]))
    return measured.select(*key, over.alias("exceeded"), (F.size(over) == 0).alias("passed"))


