"""Quality of scenes and candidates: regression metrics, gap reports, retention, guards, objectives, invariants.

Evidence that is missing stays null and is never averaged in; a mean never overrides a failed gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.functions import color, vectors
from shapelake.operators.evaluation import DIMENSIONS

# ---- regression metrics

# Share of the canvas up to which a region is tiny, side ratio up to which it is thin.
MICRO, THIN = 0.001, 0.15


def region_ratios(regions: DataFrame, micro: float = MICRO, thin: float = THIN) -> DataFrame:
    """Share of tiny and of thin regions per scene. ``regions``: image_id, area_ratio, w, h."""
    side = F.greatest(F.least("w", "h"), F.lit(1)) / F.greatest("w", "h", F.lit(1))
    return regions.groupBy("image_id").agg(
        F.count("*").alias("regions"), F.avg((F.col("area_ratio") <= micro).cast("int")).alias("micro_ratio"), F.avg((side <= thin).cast("int")).alias("thin_ratio")
    )


def anchor_recall(anchors: DataFrame, entries: DataFrame, sure: float = 0.80) -> DataFrame:
    """Share of an image's sure anchors that its palette keeps; 1 where no anchor is sure. ``anchors``: image_id,
    anchor_id, confidence; ``entries``: image_id, anchor_ids."""
    kept = entries.select("image_id", F.explode("anchor_ids").alias("anchor_id")).distinct().withColumn("kept", F.lit(1))
    d = anchors.select("image_id", "anchor_id", (F.col("confidence") >= sure).alias("sure")).distinct().join(kept, ["image_id", "anchor_id"], "left")
    n = F.count_if("sure")
    return d.groupBy("image_id").agg(F.when(n == 0, F.lit(1.0)).otherwise(F.count_if(F.col("sure") & (F.col("kept") == 1)) / n).alias("anchor_recall"))


def contrast_retention(relations: DataFrame, assigned: DataFrame) -> DataFrame:
    """How much of the wished contrasts the assigned colors keep, and how often light and dark changed places.

    ``relations``: image_id, a, b, delta_e, delta_l; ``assigned``: image_id, region, lab. A relation without contrast
    counts in neither; an image without any keeps all.
    """
    lab = assigned.select("image_id", "region", "lab")
    d = relations.join(lab.withColumnsRenamed({"region": "a", "lab": "p"}), ["image_id", "a"]).join(lab.withColumnsRenamed({"region": "b", "lab": "q"}), ["image_id", "b"])
    d = color.with_delta_e2000(d, "p", "q", "now")
    kept = F.when(F.col("delta_e") > 1e-12, F.least(F.lit(1.0), F.col("now") / F.col("delta_e")))
    flipped = (F.abs("delta_l") > 1e-12) & (F.col("delta_l") * (F.col("p.l") - F.col("q.l")) < 0)
    return d.groupBy("image_id").agg(F.coalesce(F.avg(kept), F.lit(1.0)).alias("contrast_retention"), F.count_if(flipped).alias("lightness_flips"))


def primitive_rates(primitives: DataFrame) -> DataFrame:
    """Rates of the chosen primitives per scene: converted, left as polygons, worst leakage, complexity.
    ``primitives``: image_id, kind, leakage, critical_leakage, complexity, vertices."""
    polygon = (F.col("kind") == "polygon").cast("int")
    return primitives.groupBy("image_id").agg(
        F.count("*").alias("primitives"),
        (F.lit(1.0) - F.avg(polygon)).alias("conversion_rate"),
        F.avg(polygon).alias("polygon_rate"),
        F.coalesce(F.max("leakage"), F.lit(0.0)).alias("neighbor_leakage"),
        F.max("critical_leakage").alias("critical_leakage"),
        F.sum("complexity").alias("total_complexity"),
        F.sum("vertices").alias("vertices"),
    )


def regression_metrics(regions: DataFrame, primitives: DataFrame, palette: DataFrame, anchors: DataFrame, relations: DataFrame, assigned: DataFrame) -> DataFrame:
    """All set-based regression metrics of each scene in one row. ``palette``: image_id, palette_id, anchor_ids.
    A scene without anchors has a null recall, one without relations keeps all contrast."""
    colors = palette.groupBy("image_id").agg(F.count("*").alias("palette_count"))
    d = region_ratios(regions).join(primitive_rates(primitives), "image_id", "left").join(colors, "image_id", "left")
    d = d.join(anchor_recall(anchors, palette), "image_id", "left").join(contrast_retention(relations, assigned), "image_id", "left")
    return d.fillna({"contrast_retention": 1.0, "lightness_flips": 0})


# ---- gap reports


def unit_score(value: Column) -> Column:
    """A score as double if it is within 0 and 1, else null; NaN is none."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & v.between(0.0, 1.0), v)


def gap_report(scores: DataFrame, gates: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Gate, diagnostic mean and errors of each case. ``scores``: case_id, dimension, score; ``gates``: case_id, gate.

    Every dimension must be there with a score from 0 to 1, and no other; the mean is null while there are errors.
    The gate is the hard one's, whatever the mean; a gate other than PASS and FAIL is an error and fails.
    """
    names = names or DIMENSIONS
    known = F.array(*[F.lit(n) for n in names])
    s = scores.withColumn("v", unit_score(F.col("score"))).groupBy("case_id").agg(
        F.collect_set("dimension").alias("have"), F.avg(F.when(F.col("dimension").isin(names), F.col("v"))).alias("mean"), F.array_sort(F.collect_set(F.when(F.col("v").isNull(), F.col("dimension")))).alias("bad")
    )
    d = gates.join(s, "case_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    say = lambda what, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{what}:"), x))
    bad = F.coalesce("bad", F.array().cast("array<string>"))
    gate_error = F.when(F.coalesce(F.col("gate").isin("PASS", "FAIL"), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("gate")))
    errors = F.concat(say("missing", F.array_sort(F.array_except(known, "have"))), say("unknown", F.array_sort(F.array_except("have", known))), say("range", bad), gate_error)
    d = d.withColumn("errors", errors)
    return d.select("case_id", F.when(F.col("gate") == "PASS", "PASS").otherwise("FAIL").alias("gate"), F.when(F.size("errors") == 0, F.col("mean")).alias("diagnostic_mean"), "errors")


# ---- retention and guards


def regional_retention(reference: DataFrame, candidate: DataFrame, sure: float = 0.5) -> DataFrame:
    """How much of each label's coverage the candidate keeps, at most 1; 0 if it lost the label. Both: case_id, label,
    coverage, confidence; observations that aren't sure don't count."""
    key = ["case_id", "label"]
    r = reference.filter(F.col("confidence") >= sure).groupBy(*key).agg(F.max("coverage").alias("before"))
    c = candidate.filter(F.col("confidence") >= sure).groupBy(*key).agg(F.max("coverage").alias("after"))
    ratio = F.col("after") / F.greatest("before", F.lit(1e-9))
    return r.join(c, key, "left").select(*key, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), F.lit(0.0)).alias("retention"))


def ownership_retention(overlaps: DataFrame, critical: list[str], least: float = 0.75) -> DataFrame:
    """Whether all parts kept their owner: the least overlap of each case and the parts below ``least``; a critical
    part that isn't there counts as lost. ``overlaps``: case_id, part, iou."""
    want = overlaps.select("case_id").distinct().withColumn("part", F.explode(F.array(*[F.lit(p) for p in critical]))) if critical else overlaps.select("case_id", "part").filter("false")
    d = overlaps.join(want, ["case_id", "part"], "full").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    lost = F.array_sort(F.collect_set(F.when(F.col("iou") < least, F.col("part"))))
    return d.groupBy("case_id").agg(F.min("iou").alias("least_iou"), lost.alias("lost")).withColumn("passed", F.size("lost") == 0)


def forbidden_ratio(pixels: DataFrame, delta: float) -> DataFrame:
    """Share of a masked area's pixels that differ from its base color by more than ``delta``. ``pixels``: image_id, r,
    g, b, base (struct r, g, b); an image without pixels gives no row."""
    d = color.euclid(F.struct("r", "g", "b"), F.col("base"))
    return pixels.groupBy("image_id").agg(F.avg((d > delta).cast("int")).alias("forbidden_ratio"), F.count("*").alias("pixels"))


def anatomy_gate(baseline: DataFrame, candidate: DataFrame, least: float = 0.35, most: float = 2.8) -> DataFrame:
    """Failures of each case's required parts: missing, suppressed, lost topology, extreme change of size.

    Both: case_id, part_id, required (boolean), limb (boolean), policy, box_area, constraints (array of text). One row
    per case with sorted failures and ``passed``; a case without required parts passes.
    """
    key = ["case_id", "part_id"]
    b = baseline.filter("required").select(*key, "limb", F.col("box_area").alias("before"), F.col("constraints").alias("had"))
    c = candidate.select(*key, "policy", F.col("box_area").alias("after"), F.col("constraints").alias("has"), F.lit(True).alias("there"))
    d = b.join(c, key, "left").withColumn("there", F.coalesce("there", F.lit(False)))
    none = F.array().cast("array<string>")
    ratio = F.when(F.col("limb") & (F.col("before") > 0), F.col("after") / F.col("before"))
    name = lambda what: F.concat(F.lit(f"{what}:"), "part_id")
    lost = F.array_except(F.coalesce("had", none), F.coalesce("has", none))
    found = F.concat(
        F.array_compact(F.array(F.when(~F.col("there"), name("missing")), F.when(F.col("there") & (F.col("policy") == "suppress"), name("suppressed")), F.when((ratio < least) | (ratio > most), name("extreme")))),
        F.when(F.col("there"), F.transform(lost, lambda x: F.concat(F.lit("topology:"), "part_id", F.lit(":"), x))).otherwise(none),
    )
    per = d.groupBy("case_id").agg(F.array_sort(F.flatten(F.collect_list(found))).alias("failures"))
    return baseline.select("case_id").distinct().join(per, "case_id", "left").withColumn("failures", F.coalesce("failures", none)).withColumn("passed", F.size("failures") == 0)


def candidate_gate(hard: Column, vetoes: Column, improvement: Column, least: float = 1e-6) -> Column:
    """Fate of a candidate: rejected by the hard gate, else by a veto (array of text), else if it is no better."""
    return F.when(~F.coalesce(hard, F.lit(False)), "hard_gate").when(F.size(F.coalesce(vetoes, F.array().cast("array<string>"))) > 0, "veto").when(F.coalesce(improvement, F.lit(0.0)) < least, "no_improvement").otherwise("accepted")


def all_pass(checks: DataFrame, key: list[str], passed: str, critical: str) -> DataFrame:
    """Gate over checks: it holds if every critical one does (null is a failure); the others are counted only."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return checks.groupBy(*key).agg(F.coalesce(F.bool_and(F.when(F.col(critical), ok)), F.lit(True)).alias("passed"), F.count_if(~ok & F.col(critical)).alias("critical_failures"), F.count_if(~ok & ~F.col(critical)).alias("other_failures"))


# ---- objectives

# Weights of the objective and of spatial similarity.
OBJECTIVE = {"silhouette": 3.0, "palette": 1.0, "semantic": 2.0, "primitive_count": 0.12, "tiny_shape": 0.35, "complexity": 0.08}
SIMILARITY = {"whole": 0.20, "aligned": 0.45, "coarse": 0.35}


def objective(silhouette_iou: Column, palette: Column, semantic: Column, primitives: Column, tiny: Column, complexity: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted loss of a candidate; a null term makes it null."""
    w = weights or OBJECTIVE
    terms = {"silhouette": F.lit(1.0) - silhouette_iou, "palette": palette, "semantic": semantic, "primitive_count": primitives, "tiny_shape": tiny, "complexity": complexity}
    return sum((terms[n] * w[n] for n in terms), F.lit(0.0))


def palette_loss(reference: Column, candidate: Column) -> Column:
    """Mean Lab distance, over 100, of aligned arrays of Lab structs; 0 for empty ones, null if lengths differ."""
    each = F.zip_with(reference, candidate, lambda p, q: color.euclid(p, q, ("l", "a", "b")) / 100.0)
    mean = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.size(reference)
    return F.when(F.size(reference) == F.size(candidate), F.when(F.size(reference) == 0, F.lit(0.0)).otherwise(mean))


def confidence_of(probability: Column, power: float = 2.0) -> Column:
    """How sure a probability is: its distance from one half, doubled, to a power, so only strong evidence counts."""
    return F.pow(F.least(F.lit(1.0), F.abs(probability - 0.5) * 2.0), F.lit(power))


def spatial_similarity(rows: DataFrame, key: list[str]) -> DataFrame:
    """Similarity of two feature grids: of the means, of aligned cells, and of the means of up to 4 x 4 blocks.

    ``rows``: key, y, x, h, w (of the grid), a and b (feature vectors). Cosines of two zero vectors are 1, of one 0.
    """
    # Blocks are as even as can be, the longer ones first.
    block = lambda at, n: F.when(n <= 4, at).otherwise(F.when(at < (n % 4) * (F.floor(n / 4) + 1), F.floor(at / (F.floor(n / 4) + 1))).otherwise((n % 4) + F.floor((at - (n % 4) * (F.floor(n / 4) + 1)) / F.floor(n / 4))))
    d = rows.withColumns({"_by": block(F.col("y"), F.col("h")), "_bx": block(F.col("x"), F.col("w"))})
    cell = d.groupBy(*key).agg(F.avg(vectors.cosine(F.col("a"), F.col("b"), 1.0)).alias("aligned"))
    long = d.select(*key, "_by", "_bx", F.posexplode(F.arrays_zip("a", "b")).alias("i", "v"))
    blocks = long.groupBy(*key, "_by", "_bx", "i").agg(F.sum("v.a").alias("sa"), F.sum("v.b").alias("sb"), F.count("*").alias("n"))
    vec = lambda df, by, sa, sb: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", sa.alias("v")))), lambda x: x["v"]).alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("i", sb.alias("v")))), lambda x: x["v"]).alias("b"))
    coarse = vec(blocks, [*key, "_by", "_bx"], F.col("sa") / F.col("n"), F.col("sb") / F.col("n")).groupBy(*key).agg(F.avg(vectors.cosine(F.col("a"), F.col("b"), 1.0)).alias("coarse"))
    sums = blocks.groupBy(*key, "i").agg((F.sum("sa") / F.sum("n")).alias("sa"), (F.sum("sb") / F.sum("n")).alias("sb"))
    whole = vec(sums, key, F.col("sa"), F.col("sb")).select(*key, vectors.cosine(F.col("a"), F.col("b"), 1.0).alias("whole"))
    score = sum((F.col(n) * w for n, w in SIMILARITY.items()), F.lit(0.0))
    return whole.join(cell, key).join(coarse, key).withColumn("score", score)


# ---- invariants and determinism


def invariants(scene: DataFrame, canvas: DataFrame, palette: DataFrame) -> DataFrame:
    """What must hold in every scene, one row per image and check with the number of rows that break it.

    ``scene``: image_id, region_id, palette_id, z, x, y, w, h, importance; ``canvas``: image_id, width, height;
    ``palette``: image_id, palette_id.
    """
    d = scene.join(canvas, "image_id", "left").join(palette.select("image_id", "palette_id", F.lit(True).alias("_p")).distinct(), ["image_id", "palette_id"], "left")
    twice = lambda c: F.count("*") - F.count_distinct(c)
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("width")) & (F.col("y") + F.col("h") <= F.col("height"))
    checks = {
        "unique_regions": twice("region_id"),
        "unique_order": twice("z"),
        "known_canvas": F.count_if(F.col("width").isNull()),
        "inside_canvas": F.count_if(~F.coalesce(inside, F.lit(True))),
        "known_colors": F.count_if(F.col("_p").isNull()),
        "positive_size": F.count_if(~F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))),
        "unit_importance": F.count_if(~F.coalesce(F.col("importance").between(0.0, 1.0), F.lit(False))),
    }
    per = d.groupBy("image_id").agg(*[v.cast("bigint").alias(k) for k, v in checks.items()])
    return per.unpivot("image_id", list(checks), "check", "broken").withColumn("passed", F.col("broken") == 0)


def scene_digest(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Digest of each scene's rows in their order; equal for equal scenes, however the rows are spread. A scene's rows
    meet in one task (its shapes, not its pixels)."""
    row = F.struct(*order, F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("~")) for v in values]).alias("_t"))
    return rows.groupBy(*key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_t"]), "\n"), 256).alias("digest"))


def determinism(first: DataFrame, second: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Whether two runs gave the same scenes: key, same (false also for a scene that only one of them has)."""
    a, b = (scene_digest(d, key, order, values).withColumnRenamed("digest", n) for d, n in ((first, "_a"), (second, "_b")))
    return a.join(b, key, "full").select(*key, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))
