"""Image pipelines: color strip, feature palette, stable and hierarchical abstraction.

Decoding, clustering, superpixels, merge forests and shape fitting run per image in NumPy; the tables between
them (palettes, regions, boundaries, selections, scenes) are DataFrames, and what is set-based is done there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shapelake.functions import color
from shapelake.kernels import boundary, raster, tree
from shapelake.operators import pixels, ranking, regions
from shapelake.session import materialize


def per_image(images: DataFrame, f: Callable[[str, np.ndarray, np.ndarray | None], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``f(image_id, rgb, alpha)`` yields for each decoded image; images without data give none.
    Batches close after 64k rows."""
    names = [c.strip().split()[0] for c in schema.split(",") if c.strip()] if "<" not in schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.data is None or not r.width:
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.n_channels))
                rgb = np.repeat(a, 3, 2) if r.n_channels == 1 else a[:, :, 2::-1]
                rows: list[dict] = []
                for row in f(r.image_id, rgb, a[:, :, 3] if r.n_channels == 4 else None):
                    rows.append(row)
                    if len(rows) >= 65_536:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return images.select("image_id", "width", "height", "n_channels", "data").mapInPandas(run, schema)


def per_image_columns(images: DataFrame, f: Callable[[str, np.ndarray, np.ndarray | None], Iterator[dict]], schema: str, batch: int = 65_536) -> DataFrame:
    """Rows of each decoded image that ``f(image_id, rgb, alpha)`` yields as columns (arrays of one length; the image's id
    is added), cut into batches. For tables of pixels, which would be slow as single rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.data is None or not r.width:
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.n_channels))
                rgb = np.repeat(a, 3, 2) if r.n_channels == 1 else a[:, :, 2::-1]
                for columns in f(r.image_id, rgb, a[:, :, 3] if r.n_channels == 4 else None):
                    n = len(next(iter(columns.values())))
                    for i in range(0, n, batch):
                        part = pd.DataFrame({k: v[i : i + batch] for k, v in columns.items()})
                        part.insert(0, "image_id", r.image_id)
                        yield part

    return images.select("image_id", "width", "height", "n_channels", "data").mapInPandas(run, f"image_id string, {schema}")


def _scaled(a: np.ndarray, side: int | None) -> np.ndarray:
    """An image no longer than ``side``; at its own size without one."""
    return a if side is None else raster.resize_nearest(a, side)


# ---- color strip


def color_counts(px: DataFrame, step: int = 8) -> DataFrame:
    """Visible pixels per grid cell with the cell's mean color: one combining aggregation."""
    q = [F.floor(F.col(c) / step).alias(f"q{c}") for c in "rgb"]
    return px.filter("a > 0").groupBy("image_id", *q).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"]).drop("qr", "qg", "qb")


def merge_colors(counts: DataFrame, similarity: float = 12.0) -> DataFrame:
    """Cells joined to the nearest cluster within ``similarity`` (Lab), largest first, clusters moving to their
    weighted mean. The order is the semantics: one small task per image (at most (256/step)^3 cells)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["n", "r", "g", "b"], ascending=[False, True, True, True])
        sums, mass, labs = [], [], np.empty((0, 3))
        for n, *rgb in rows[["n", "r", "g", "b"]].itertuples(index=False):
            lab = raster.to_lab(np.array(rgb))
            d = np.sqrt(((labs - lab) ** 2).sum(1)) if len(labs) else np.array([np.inf])
            i = int(d.argmin())
            if d[i] <= similarity:
                sums[i] += n * np.array(rgb)
                mass[i] += n
                labs[i] = raster.to_lab(sums[i] / mass[i])
            else:
                sums.append(n * np.array(rgb))
                mass.append(n)
                labs = np.vstack([labs, lab])
        return pd.DataFrame([(pdf.image_id.iat[0], int(m), *(int(round(v)) for v in s / m)) for s, m in zip(sums, mass, strict=True)], columns=["image_id", "n", "r", "g", "b"])

    return counts.groupBy("image_id").applyInPandas(run, "image_id string, n bigint, r int, g int, b int")


def feature_score(contrast: Column, chroma: Column, share: Column, scales: tuple[float, float, float] = (60.0, 80.0, 0.05)) -> Column:
    """0.45 contrast, 0.35 chroma, 0.20 share, each against its scale and at most 1."""
    one = F.lit(1.0)
    return F.least(contrast / scales[0], one) * 0.45 + F.least(chroma / scales[1], one) * 0.35 + F.least(share / scales[2], one) * 0.20


def color_strip(px: DataFrame, count: int = 5, similarity: float = 12.0, feature: bool = False, length: int = 1000, proportional: bool = True, min_share: float = 0.002) -> DataFrame:
    """The strip of every image: its ``count`` dominant colors (with ``feature``, the last place goes to the
    most salient other color), pixels of each by nearest color, share, hex, and segment on ``length``."""
    merged = merge_colors(color_counts(px), similarity)
    ranked = merged.withColumns({"rank": F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")), "share": F.col("n") / F.sum("n").over(W.partitionBy("image_id")), "lab": color.lab(F.col("r"), F.col("g"), F.col("b"))})
    top = ranked.filter(F.col("rank") <= (max(1, count - 1) if feature else count))
    if feature:
        others = ranked.join(top.select("image_id", "rank"), ["image_id", "rank"], "left_anti").filter(F.col("share") >= min_share)
        near = others.alias("o").join(top.alias("t"), "image_id").groupBy("image_id", F.col("o.rank").alias("rank")).agg(F.min(color.delta_e76(F.col("o.lab"), F.col("t.lab"))).alias("contrast"))
        scored = others.join(near, ["image_id", "rank"]).withColumn("score", feature_score(F.col("contrast"), color.chroma(F.col("lab")), F.col("share")))
        best = scored.groupBy("image_id").agg(F.max_by("rank", F.struct("score", "n", (-F.col("rank")).alias("k"))).alias("rank"))
        top = top.unionByName(ranked.join(best, ["image_id", "rank"]).select(*top.columns))
    centers = top.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lab", "r", "g", "b"))).alias("centers"))
    cells = color_counts(px).withColumn("lab", color.lab(F.col("r"), F.col("g"), F.col("b"))).join(centers, "image_id")
    pick = F.array_min(F.transform("centers", lambda c: F.struct(F.round(color.delta_e76(F.col("lab"), c["lab"]), 9).alias("d"), c["rank"].alias("rank"), c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))))
    got = cells.withColumn("c", pick).groupBy("image_id", "c.rank", "c.r", "c.g", "c.b").agg(F.sum("n").alias("pixels"))
    got = got.withColumns({"share": F.col("pixels") / F.sum("pixels").over(W.partitionBy("image_id")), "hex": color.hex_color(F.col("r"), F.col("g"), F.col("b"))})
    got = got.withColumn("_bar", F.col("share") if proportional else F.lit(0.0))
    return ranking.proportional_bounds(got, ["image_id"], "_bar", F.lit(length), [F.desc("pixels"), F.col("rank")]).drop("_bar", "rank")


def strip_svg(strip: DataFrame, length: int, height: int) -> DataFrame:
    """SVG of each strip, bars from left to right."""
    bar = F.format_string(f'  <rect x="%d" y="0" width="%d" height="{height}" fill="%s"/>', F.col("start"), F.col("stop") - F.col("start"), F.col("hex"))
    per = strip.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", bar.alias("e")))), lambda s: s["e"]), "\n").alias("body"))
    return per.select("image_id", F.concat_ws("\n", F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{length}" height="{height}" viewBox="0 0 {length} {height}">'), "body", F.lit("</svg>")).alias("svg"))


def feature_palette(images: DataFrame, clusters: int = 12, most: int = 6, sample: int = 20_000) -> DataFrame:
    """Role colors of each image beside its backdrop: k-means in Lab, then share, chroma, spread, family and
    score per cluster; Main by score, then Accent by chroma among colors far from it, then Support. Centers are fitted
    on up to ``sample`` evenly spaced pixels; every pixel is assigned to them and counts."""

    def run(image_id, rgb, alpha):
        keep = ~raster.border_flood(rgb) & (alpha > 0 if alpha is not None else True)
        if not keep.any():
            keep = np.ones(rgb.shape[:2], bool)
        y, x = np.nonzero(keep)
        lab = raster.to_lab(rgb[y, x])
        fit = np.linspace(0, len(y) - 1, min(sample, len(y))).astype(int)
        centers, _ = raster.kmeans(lab[fit], clusters)
        label = np.concatenate([((lab[i : i + 65_536, None] - centers[None]) ** 2).sum(2).argmin(1) for i in range(0, len(lab), 65_536)])
        for i in np.unique(label):
            m = label == i
            c = rgb[y[m], x[m]].mean(0)
            l = raster.to_lab(c)
            spread = (min(1.0, x[m].std() / max(1, rgb.shape[1] * 0.22)) + min(1.0, y[m].std() / max(1, rgb.shape[0] * 0.22))) / 2
            yield {"image_id": image_id, "cluster": int(i), "r": int(round(c[0])), "g": int(round(c[1])), "b": int(round(c[2])), "share": float(m.mean()), "chroma": float(np.hypot(l[1], l[2])), "lightness": float(l[0]), "spread": float(spread)}

    rows = per_image(images, run, "image_id string, cluster int, r int, g int, b int, share double, chroma double, lightness double, spread double")
    neutral = F.when(F.col("chroma") < 10, F.when(F.col("lightness") >= 80, "light").when(F.col("lightness") <= 25, "dark").otherwise("neutral"))
    rows = rows.withColumns({"neutral": neutral, "lab": color.lab(F.col("r"), F.col("g"), F.col("b"))})
    rows = rows.withColumns({"family": color.color_family(F.col("lab"), F.col("neutral")), "score": F.sqrt("share") * 0.55 + F.least(F.lit(1.0), F.col("chroma") / 80) * 0.30 + F.col("spread") * 0.15})
    w = W.partitionBy("image_id").orderBy(F.desc("score"), "cluster")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    role = F.when(F.col("rank") == 1, "main").when(F.col("neutral").isNotNull(), "neutral").when((F.col("share") <= 0.15) & (F.col("chroma") >= 30), "accent").otherwise("support")
    return rows.withColumn("role", role)


# ---- stable abstraction: clusters -> regions -> roles -> layers -> shapes


def color_regions(images: DataFrame, colors: int = 8, side: int | None = 256, least: float = 0.0008) -> DataFrame:
    """Label pixels of connected regions of quantized colors: image_id, y, x, region, palette_id, r, g, b. Images are
    analysed at up to ``side`` pixels, or at their own size without it."""

    def run(image_id, rgb, alpha):
        small = _scaled(rgb, side)
        mask = _scaled(alpha, side) > 0 if alpha is not None else np.ones(small.shape[:2], bool)
        c, label = raster.kmeans(raster.to_lab(small[mask]), colors) if mask.any() else (None, np.empty(0, int))
        q = np.full(small.shape[:2], -1)
        q[mask] = label
        comp = raster.components(q, 8)
        big = np.bincount(comp[comp >= 0], minlength=1) >= least * comp.size
        y, x = np.nonzero((comp >= 0) & big[np.maximum(comp, 0)])
        h, w = comp.shape
        i32 = lambda a: a.astype(np.int32)
        yield {"y": i32(y), "x": i32(x), "region": i32(comp[y, x]), "palette_id": i32(q[y, x]), **{n: i32(small[y, x, k]) for k, n in enumerate("rgb")}, "width": np.full(len(y), w, np.int32), "height": np.full(len(y), h, np.int32)}

    return per_image_columns(images, run, "y int, x int, region int, palette_id int, r int, g int, b int, width int, height int")


def region_table(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, palette and canvas from label pixels: aggregates that combine map-side."""
    canvas = labels.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    per = labels.groupBy("image_id", F.col("region").alias("region_id")).agg(
        F.max("palette_id").alias("palette_id"),
        F.count("*").alias("area"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"],
        F.max((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)).alias("touches_edge"),
    )
    per = per.join(canvas, "image_id").withColumns({"area_ratio": F.col("area") / (F.col("width") * F.col("height")), "is_accent": F.lit(False)}).drop("width", "height")
    total = W.partitionBy("image_id")
    palette = labels.groupBy("image_id", "palette_id").agg(F.count("*").alias("n"), *[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"]).withColumn("ratio", F.col("n") / F.sum("n").over(total))
    return per, palette, canvas


WEIGHTS = {"area": 0.40, "contrast": 0.25, "rarity": 0.20, "structure": 0.15}


def fit_shapes(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shape of every chosen region: image_id, region_id, kind, box, points, iou. A region's pixels meet in one
    task (it is part of one image)."""
    px = labels.select("image_id", F.col("region").alias("region_id"), "y", "x").join(chosen.select("image_id", "region_id"), ["image_id", "region_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), bool)
        m[pdf.y, pdf.x] = True
        s = raster.fit_shape(m)
        return pd.DataFrame([(pdf.image_id.iat[0], int(pdf.region_id.iat[0]), s["kind"], list(s["box"]), [{"x": x, "y": y} for x, y in s["points"]], s["iou"])], columns=["image_id", "region_id", "kind", "box", "points", "iou"])

    return px.groupBy("image_id", "region_id").applyInPandas(run, "image_id string, region_id int, kind string, box array<double>, points array<struct<x:double,y:double>>, iou double")


def stable_scene(images: DataFrame, shapes: int = 40, colors: int = 8, side: int | None = 256) -> dict[str, DataFrame]:
    """Quantize, find regions, rate and name them, choose by layer quotas, fit shapes, order them.

    Stage tables are written to the shared folder, as each is read several times and the kernels before them
    should run once."""
    labels = materialize(color_regions(images, colors, side), "labels")
    table, palette, canvas = (materialize(t, "regions") for t in region_table(labels))
    round_ = F.least(F.lit(1.0), F.col("area") / F.greatest(F.lit(1.0), F.col("w") * F.col("h")))
    long_ = F.least(F.lit(1.0), (F.greatest("w", "h") / F.greatest(F.lit(1.0), F.least("w", "h")) - 1.0) / 5.0)
    table = table.withColumns({"structure_score": F.greatest(round_, long_ * 0.7), "solidity": round_})
    rated = regions.score_importance(table, palette, WEIGHTS, 0.0008)
    rated = rated.join(regions.background_region(rated), "image_id").withColumn("is_background", F.col("region_id") == F.col("background_id")).drop("background_id")
    named = materialize(regions.assign_layers(regions.assign_semantics(regions.assign_roles(materialize(rated, "rated"), canvas), canvas), canvas), "named")
    kept = materialize(regions.keep_regions(named, 0.0008, shapes * 2), "kept")
    quotas = ranking.layer_budget(shapes, {"skyline": 0.28, "midground": 0.34, "water": 0.12, "foreground": 0.12, "accents": 0.14}, ["midground", "skyline", "foreground", "accents", "water"], ["accents", "water", "foreground", "midground", "skyline"])
    back = named.filter("is_background").withColumn("picked", F.lit("background"))
    chosen = regions.draw_order(regions.select_layers(kept, quotas).unionByName(back)).withColumn("z", F.when(F.col("picked") == "background", -1).otherwise(F.col("z")))
    chosen = materialize(chosen, "chosen")
    design = regions.design_palette(palette).select("image_id", "palette_id", F.col("out_r").alias("r"), F.col("out_g").alias("g"), F.col("out_b").alias("b"))
    drawn = fit_shapes(labels, chosen).join(chosen.select("image_id", "region_id", "palette_id", "z", "layer", "role"), ["image_id", "region_id"]).join(design, ["image_id", "palette_id"])
    return {"labels": labels, "regions": named, "palette": palette, "canvas": canvas, "chosen": chosen, "shapes": drawn}


# ---- hierarchical abstraction: superpixels -> boundaries -> merge forest -> nested cuts


def superpixel_labels(images: DataFrame, target: int = 300, side: int | None = 192) -> DataFrame:
    """Superpixel pixels with Lab and the edge map, raw and smoothed: image_id, y, x, region, l, ca, cb, raw, soft. Images
    are analysed at up to ``side`` pixels, or at their own size without it."""

    def run(image_id, rgb, alpha):
        lab = raster.to_lab(_scaled(rgb, side))
        s = raster.superpixels(lab, target)
        e = raster.edges(lab)
        soft = np.clip(raster.gaussian(e, 5), 0, 1)
        y, x = (v.reshape(-1).astype(np.int32) for v in np.indices(s.shape))
        yield {"y": y, "x": x, "region": s.reshape(-1).astype(np.int32), **{n: lab[:, :, k].reshape(-1).astype(float) for k, n in enumerate(("l", "ca", "cb"))}, "raw": e.reshape(-1).astype(float), "soft": soft.reshape(-1).astype(float)}

    return per_image_columns(images, run, "y int, x int, region int, l double, ca double, cb double, raw double, soft double")


def merge_and_cut(stats: DataFrame, boundary: DataFrame, perimeter: DataFrame, counts: list[int]) -> DataFrame:
    """Nested cuts of each image's merge forest: image_id, wanted, region (leaf), node. The forest of an image is
    built by one task from its region and boundary tables (hundreds of rows), not from pixels."""
    r = stats.join(perimeter, ["image_id", "region"]).select("image_id", F.struct(F.lit(0).alias("k"), F.col("region").alias("a"), F.lit(-1).alias("b"), F.array(F.col("n").cast("double"), "s_l", "s_ca", "s_cb", F.col("perimeter_px").cast("double")).alias("v")).alias("row"))
    e = boundary.select("image_id", F.struct(F.lit(1).alias("k"), "a", "b", F.array(F.col("shared_px").cast("double"), "boundary_cost").alias("v")).alias("row"))
    per = r.unionByName(e).groupBy("image_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def run(frames):
        for pdf in frames:
            for image_id, rows in zip(pdf.image_id, pdf.rows, strict=True):
                regions_ = {int(x["a"]): tuple(x["v"]) for x in rows if x["k"] == 0}
                edges_ = [(int(x["a"]), int(x["b"]), *x["v"]) for x in rows if x["k"] == 1]
                nodes, order = tree.merge_forest(regions_, edges_)
                out = []
                for wanted, cut in tree.nested_cuts(nodes, order, counts).items():
                    out += [(image_id, wanted, leaf, node) for leaf, node in sorted(tree.leaves_under(nodes, cut).items())]
                yield pd.DataFrame(out, columns=["image_id", "wanted", "region", "node"])

    return per.mapInPandas(run, "image_id string, wanted int, region int, node int")


def hierarchical_scene(images: DataFrame, counts: tuple[int, ...] = (12, 24, 48, 96), target: int = 300, side: int | None = 192) -> dict[str, DataFrame]:
    """Superpixels, region statistics, boundaries, forest and nested cuts; labels of each cut by a join. Stage
    tables are written to the shared folder."""
    labels = materialize(superpixel_labels(images, target, side), "labels")
    stats = pixels.region_stats(labels, {c: F.col(c) for c in ("l", "ca", "cb")})
    boundary = materialize(pixels.boundary_evidence(labels, "raw", "soft"), "boundary")
    cuts = materialize(merge_and_cut(stats, boundary, pixels.perimeters(labels), list(counts)), "cuts")
    selected = labels.join(cuts, ["image_id", "region"]).select("image_id", "wanted", "y", "x", F.col("node").alias("region"), "l", "ca", "cb")
    return {"labels": labels, "stats": stats, "boundary": boundary, "cuts": cuts, "selected": selected}


def boundary_chains(selected: DataFrame, key: list[str], tolerance: float = 1.0) -> DataFrame:
    """Shared outlines of each label image (``key`` names its columns; y, x, region its pixels): a row per chain
    with the regions on both sides, simplified once for both. One image per task."""
    head = selected.select(*key)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lab = np.full((pdf.y.max() + 1, pdf.x.max() + 1), boundary.OUTSIDE)
        lab[pdf.y, pdf.x] = pdf.region
        rows = boundary.simplified(boundary.chains(lab), tolerance)
        at = [pdf[k].iat[0] for k in key]
        return pd.DataFrame([(*at, i, c["right"], c["left"], c["closed"], [{"x": x, "y": y} for x, y in c["points"]]) for i, c in enumerate(rows)], columns=[*key, "chain", "a", "b", "closed", "points"])

    return selected.select(*key, "y", "x", "region").groupBy(*key).applyInPandas(run, f"{ddl}, chain int, a int, b int, closed boolean, points array<struct<x:double,y:double>>")
