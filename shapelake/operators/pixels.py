"""Set operators on pixel tables: signatures, masks, runs, adjacency, statistics.

A pixel table has ``image_id, y, x`` and channels ``r, g, b`` (``a``); a label table has ``image_id, y, x,
region``; a mask table ``image_id, y, x``. The image is part of every key, so the work of an image spreads
over tasks by rows or groups and no step holds an image in one place. Neighbours come from one window per
row or column of pixels, not from a self-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import color

PIXELS = "image_id string, y int, x int, r int, g int, b int, a int"


def to_pixels(images: DataFrame, rows_per_batch: int = 1 << 16) -> DataFrame:
    """Pixels of decoded images (image_id, width, height, n_channels, data in BGR(A) or gray order).

    Gray images get equal channels, images without alpha are opaque; an image without data gives nothing.
    Batches are bounded, so memory is one image's bytes and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w, h, n, data = row["width"], row["height"], row["n_channels"], row["data"]
                if not data or not w or not h:
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                b, g, r = (p[:, 0],) * 3 if n == 1 else (p[:, 0], p[:, 1], p[:, 2])
                a = p[:, 3] if n == 4 else np.full(h * w, 255, np.int32)
                for i in range(0, h * w, rows_per_batch):
                    j = min(h * w, i + rows_per_batch)
                    at = np.arange(i, j, dtype=np.int32)
                    cols = [pa.array([row["image_id"]] * (j - i)), at // w, at % w, r[i:j], g[i:j], b[i:j], a[i:j]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["image_id", "y", "x", "r", "g", "b", "a"])

    return images.select("image_id", "width", "height", "n_channels", "data").mapInArrow(run, PIXELS)


def flatten_alpha(pixels: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Pixels over a solid background."""
    done = {c: color.composite(F.col(c), F.col("a"), F.lit(v)) for c, v in zip("rgb", background, strict=True)}
    return pixels.withColumns(done)


def has_transparency(pixels: DataFrame, below: int = 250) -> DataFrame:
    """Per image, whether any pixel is materially transparent."""
    return pixels.groupBy("image_id").agg(F.max(F.col("a") < below).alias("transparent"))


# ---- color signatures and survival


def signatures(rows: DataFrame, key: list[str], cell: list[Column], x: Column, y: Column, min_share: float = 0.002, top: int = 24) -> DataFrame:
    """The strongest grid cells of each group: share of rows, mean place, rank.

    ``cell`` are the cell's coordinates (for colors, quantized channels). Cells below ``min_share`` are left
    out; of the others the ``top`` by (-share, cell) are kept, which is this operator's feature, not a limit
    on its input. One combining aggregation, then windows over cells only.
    """
    names = [f"c{i}" for i in range(len(cell))]
    cells = rows.groupBy(*key, *[c.alias(n) for c, n in zip(cell, names, strict=True)]).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    group = W.partitionBy(*key)
    shares = cells.withColumn("share", F.col("n") / F.sum("n").over(group)).filter(F.col("share") >= min_share)
    rank = F.row_number().over(group.orderBy(F.desc("share"), *names))
    return shares.withColumn("rank", rank).filter(F.col("rank") <= top)


def color_signatures(pixels: DataFrame, sizes: DataFrame, step: int = 32, min_share: float = 0.002, top: int = 24) -> DataFrame:
    """Color signatures of images: quantized color, share, center in 0..1. ``sizes``: image_id, width, height."""
    p = pixels.join(sizes.select("image_id", "width", "height"), "image_id")
    x = F.col("x") / F.greatest(F.lit(1), F.col("width") - 1)
    y = F.col("y") / F.greatest(F.lit(1), F.col("height") - 1)
    s = signatures(p, ["image_id"], [color.quantize(F.col(c), step) for c in "rgb"], x, y, min_share, top)
    return s.select("image_id", F.col("c0").alias("r"), F.col("c1").alias("g"), F.col("c2").alias("b"), "share", "cx", "cy", "rank")


def signature_distance(p: str, q: str) -> Column:
    """0.72 color and 0.28 place, each against its greatest distance."""
    c = F.sqrt(sum((F.pow(F.col(f"{p}.{n}") - F.col(f"{q}.{n}"), F.lit(2.0)) for n in "rgb"), F.lit(0.0))) / 441.673
    d = F.hypot(F.col(f"{p}.cx") - F.col(f"{q}.cx"), F.col(f"{p}.cy") - F.col(f"{q}.cy")) / 1.414214
    return c * 0.72 + d * 0.28


def supported(required: DataFrame, present: DataFrame, distance: Column, threshold: float, key: list[str], missing: bool = False) -> DataFrame:
    """Rows of ``required`` that have (or, ``missing``, have not) a row of ``present`` within ``threshold``.

    Both are bounded per key (signatures are a top-k), so the residual condition sees few pairs per key.
    """
    on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in key]
    return required.alias("p").join(present.alias("q"), [*on, distance <= threshold], "left_anti" if missing else "left_semi")


def survival(baseline: DataFrame, current: DataFrame, source: DataFrame | None = None, threshold: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """Signatures that must survive and do not, and the gate per image.

    With ``source`` only baseline signatures that the source supports are required. An image without missing
    signatures passes; an image without any current signature misses all that are required.
    """
    d = signature_distance("p", "q")
    required = baseline if source is None else supported(baseline, source, d, threshold, ["image_id"])
    missing = supported(required, current, d, threshold, ["image_id"], missing=True)
    counts = missing.groupBy("image_id").agg(F.count("*").alias("missing"))
    gate = baseline.select("image_id").distinct().join(counts, "image_id", "left").select("image_id", F.coalesce("missing", F.lit(0)).alias("missing"))
    return missing, gate.withColumn("passed", F.col("missing") == 0)


# ---- masks and runs


def encode_runs(mask: DataFrame, key: list[str]) -> DataFrame:
    """Half-open runs [x0, x1) of consecutive x in each row; repeated pixels count once."""
    rows = mask.select(*key, "y", "x").distinct()
    island = F.col("x") - F.row_number().over(W.partitionBy(*key, "y").orderBy("x"))
    return rows.withColumn("_i", island).groupBy(*key, "y", "_i").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_i")


def decode_runs(runs: DataFrame, key: list[str], width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels of runs, and the runs refused: empty, reversed, off the canvas or overlapping the run before."""
    w = W.partitionBy(*key, "y").orderBy("x0", "x1")
    bad = (F.col("x1") <= F.col("x0")) | (F.col("x0") < 0) | F.coalesce(F.lag("x1").over(w) > F.col("x0"), F.lit(False))
    if width is not None:
        bad = bad | (F.col("x1") > width)
    marked = runs.withColumn("_bad", bad)
    pixels = marked.filter(~F.col("_bad")).select(*key, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return pixels, marked.filter("_bad").drop("_bad")


def iou(a: DataFrame, b: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """Intersection over union of two sets of items per key; 1 where both are empty can't occur, as a key
    without items has no row. Tagged union and one aggregation, no join; repeated items count once."""
    both = a.select(*key, *item, F.lit(1).alias("s")).unionByName(b.select(*key, *item, F.lit(2).alias("s")))
    per = both.groupBy(*key, *item).agg(F.bit_or("s").alias("s"))
    return per.groupBy(*key).agg(F.count_if(F.col("s") == 3).alias("both"), F.count("*").alias("either")).withColumn("iou", F.col("both") / F.col("either"))


def changed_share(a: DataFrame, b: DataFrame, threshold: int = 24) -> DataFrame:
    """Per image, the share of pixels of which some channel differs by ``threshold`` or more."""
    j = a.alias("p").join(b.alias("q"), ["image_id", "y", "x"])
    over = F.greatest(*[F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in "rgb"]) >= threshold
    return j.groupBy("image_id").agg(F.avg(over.cast("int")).alias("changed"))


def sanity(pixels: DataFrame, white: int = 250, min_share: float = 0.01, min_colors: int = 2) -> DataFrame:
    """Render sanity: share of pixels that aren't white, distinct colors, box share, reasons against it."""
    ink = F.least("r", "g", "b") < white
    size = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    box = (F.max(F.when(ink, F.col("x"))) - F.min(F.when(ink, F.col("x"))) + 1) * (F.max(F.when(ink, F.col("y"))) - F.min(F.when(ink, F.col("y"))) + 1)
    per = pixels.groupBy("image_id").agg(F.avg(ink.cast("int")).alias("ink_share"), F.count_distinct("r", "g", "b").alias("colors"), F.coalesce(box / size, F.lit(0.0)).alias("box_share"))
    why = F.array_compact(F.array(F.when(F.col("ink_share") < min_share, "nearly_blank"), F.when(F.col("colors") < min_colors, "too_few_colors")))
    return per.withColumn("reasons", why).withColumn("sane", F.size("reasons") == 0)


# ---- adjacency and statistics


def neighbour_pairs(labels: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Every pair of touching pixels (4-connected) with different labels: image_id, a < b, and of each value
    column the greater of the two. Two windows (rows, columns); no pixel is joined."""
    more = values or []
    sides = []
    for group, order in (("y", "x"), ("x", "y")):
        w = W.partitionBy("image_id", group).orderBy(order)
        nxt = labels.withColumns({"_next": F.lead("region").over(w), "_step": F.lead(order).over(w) - F.col(order), **{f"_{v}": F.lead(v).over(w) for v in more}})
        touching = nxt.filter((F.col("_step") == 1) & (F.col("_next") != F.col("region")))
        sides.append(touching.select("image_id", F.least("region", "_next").alias("a"), F.greatest("region", "_next").alias("b"), *[F.greatest(v, f"_{v}").alias(v) for v in more]))
    return sides[0].unionByName(sides[1])


def adjacency(labels: DataFrame) -> DataFrame:
    """Shared boundary length of every pair of touching regions."""
    return neighbour_pairs(labels).groupBy("image_id", "a", "b").agg(F.count("*").alias("shared_px"))


def perimeters(labels: DataFrame) -> DataFrame:
    """Boundary length of every region, the canvas border included."""
    outer = []
    for group, order in (("y", "x"), ("x", "y")):
        w = W.partitionBy("image_id", group).orderBy(order)
        for step in (F.lag, F.lead):
            other = step("region").over(w)
            near = F.abs(step(order).over(w) - F.col(order)) == 1
            outer.append(F.when(F.coalesce(near & (other == F.col("region")), F.lit(False)), 0).otherwise(1))
    return labels.withColumn("_p", sum(outer[1:], outer[0])).groupBy("image_id", "region").agg(F.sum("_p").alias("perimeter_px"))


def region_stats(labels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Sufficient statistics of every region: count, box, first and second moments of place, sum and sum of
    squares of each value. All are sums, minima and maxima, so the aggregation combines map-side, and
    statistics of unions of regions follow from those of the regions (``merge_stats``)."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    aggs = [F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    aggs += [F.sum(v).alias(k) for k, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))]
    for name, v in values.items():
        aggs += [F.sum(v).alias(f"s_{name}"), F.sum(v * v).alias(f"ss_{name}")]
    return labels.groupBy("image_id", "region").agg(*aggs)


def merge_stats(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Statistics of merged regions; ``mapping``: image_id, region, target."""
    low, high = {"x0", "y0"}, {"x1", "y1"}
    cols = [c for c in stats.columns if c not in ("image_id", "region")]
    aggs = [(F.min if c in low else F.max if c in high else F.sum)(c).alias(c) for c in cols]
    return stats.join(mapping, ["image_id", "region"]).groupBy("image_id", F.col("target").alias("region")).agg(*aggs)


def histogram(rows: DataFrame, key: list[str], value: Column, bins: int = 32) -> DataFrame:
    """Histogram arrays of values in 0..1, the last bin closed; keys without values have no row."""
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins))).cast("int")
    counts = rows.filter(value.isNotNull()).groupBy(*key, bin_.alias("bin")).agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    return counts.groupBy(*key).agg(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0).cast("bigint"))).alias("hist"))


def hist_quantile(hist: Column, q: float) -> Column:
    """The quantile's bin as a share of the last bin: the first whose running count reaches q (n-1) + 1."""
    total = F.aggregate(hist, F.lit(0).cast("bigint"), lambda s, v: s + v)
    target = (total - 1) * q + 1.0
    running = F.transform(F.sequence(F.lit(1), F.size(hist)), lambda i: F.aggregate(F.slice(hist, 1, i), F.lit(0).cast("bigint"), lambda s, v: s + v))
    index = F.size(F.filter(running, lambda v: v < target))
    return F.when(total <= 0, 0.0).otherwise(F.least(index, F.size(hist) - 1) / F.greatest(F.lit(1), F.size(hist) - 1))


def boundary_evidence(labels: DataFrame, raw: str, structural: str) -> DataFrame:
    """Per boundary: length, and the cost from quantiles of both gradient histograms."""
    pairs = neighbour_pairs(labels, [raw, structural])
    key = ["image_id", "a", "b"]
    h = histogram(pairs, key, F.col(raw)).withColumnRenamed("hist", "raw_hist").join(histogram(pairs, key, F.col(structural)).withColumnRenamed("hist", "structural_hist"), key)
    s = hist_quantile(F.col("structural_hist"), 0.75) * 0.45 + hist_quantile(F.col("structural_hist"), 0.90) * 0.55
    r = hist_quantile(F.col("raw_hist"), 0.90) * 0.40 + hist_quantile(F.col("raw_hist"), 0.98) * 0.60
    return h.join(pairs.groupBy(*key).agg(F.count("*").alias("shared_px")), key).withColumn("boundary_cost", F.least(F.lit(1.0), F.greatest(s, r * 0.35)))


def winner(rows: DataFrame, key: list[str], choice: str) -> DataFrame:
    """Per key the most frequent choice, its count, that of the runner-up and the margin between their shares.
    Ties go to the smaller choice. Counting combines map-side; windows see one row per (key, choice)."""
    counts = rows.groupBy(*key, choice).agg(F.count("*").alias("n"))
    w = W.partitionBy(*key).orderBy(F.desc("n"), choice)
    ranked = counts.withColumns({"rank": F.row_number().over(w), "second": F.lead("n").over(w), "total": F.sum("n").over(W.partitionBy(*key))})
    second = F.coalesce("second", F.lit(0))
    return ranked.filter("rank = 1").select(*key, F.col(choice).alias("winner"), "n", second.alias("second"), ((F.col("n") - second) / F.col("total")).alias("margin"))
