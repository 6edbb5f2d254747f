"""Boxes ``array(x, y, w, h)``, point lists ``array<struct<x, y>>`` and shapes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] * box[3])


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller of two boxes, 0 if that has no area."""
    ix = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    iy = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(ix * iy / F.nullif(F.least(box_area(a), box_area(b)), F.lit(0.0)), F.lit(0.0))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """The part of a box on the canvas; null if nothing of it is."""
    x0, y0 = F.greatest(F.lit(0.0), box[0]), F.greatest(F.lit(0.0), box[1])
    x1, y1 = F.least(width.cast("double"), box[0] + box[2]), F.least(height.cast("double"), box[1] + box[3])
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1 - x0, y1 - y0))


def union_box(box: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    x0, y0 = F.min(box[0]), F.min(box[1])
    return F.array(x0, y0, F.max(box[0] + box[2]) - x0, F.max(box[1] + box[3]) - y0)


def points_box(points: Column) -> Column:
    """Bounding box of a point list."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def polygon_area(points: Column) -> Column:
    """Area of a closed polygon (shoelace); 0 below three points."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2.0).otherwise(0.0)


def perimeter(points: Column) -> Column:
    """Length around a closed polygon."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    side = F.zip_with(points, nxt, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return F.aggregate(side, F.lit(0.0), lambda s, v: s + v)


def circularity(area: Column, length: Column) -> Column:
    """4 pi A / P^2, 0 without perimeter."""
    return F.coalesce(area * (4.0 * math.pi) / F.nullif(length * length, F.lit(0.0)), F.lit(0.0))


def shape_area(kind: Column, width: Column, height: Column, rx: Column, ry: Column, points: Column) -> Column:
    """Area of a shape by its kind; lines have none."""
    return (
        F.when(kind == "rectangle", F.greatest(F.lit(0.0), F.coalesce(width, F.lit(0.0)) * F.coalesce(height, F.lit(0.0))))
        .when(kind == "circle", F.pow(F.coalesce(rx, F.lit(0.0)), F.lit(2.0)) * math.pi)
        .when(kind == "ellipse", F.coalesce(rx, F.lit(0.0)) * F.coalesce(ry, F.lit(0.0)) * math.pi)
        .when(kind == "polygon", polygon_area(points))
        .otherwise(0.0)
    )


def vertex_count(kind: Column, points: Column) -> Column:
    """Vertices a shape is drawn with."""
    return F.when(kind == "polygon", F.size(points)).when(kind == "line", 2).otherwise(4)


def transform_points(points: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """Scaled, then moved points."""
    return F.transform(points, lambda p: F.struct((p["x"] * scale + dx).alias("x"), (p["y"] * scale + dy).alias("y")))


def pad_points(points: Column, width: Column, height: Column, ratio: Column) -> Column:
    """Points shrunk about the canvas center, leaving ``ratio`` of it free on each side."""
    keep = F.lit(1.0) - ratio * 2.0
    return F.transform(points, lambda p: F.struct((width * ratio + p["x"] * keep).alias("x"), (height * ratio + p["y"] * keep).alias("y")))


def spread(x: Column, y: Column, width: Column, height: Column, unit: float = 0.22) -> Column:
    """Aggregate: mean of the spreads along both axes against ``unit`` of the canvas, each at most 1."""
    sx = F.least(F.lit(1.0), F.stddev_pop(x) / F.greatest(F.lit(1.0), F.max(width) * unit))
    sy = F.least(F.lit(1.0), F.stddev_pop(y) / F.greatest(F.lit(1.0), F.max(height) * unit))
    return F.when(F.count(x) < 2, 0.0).otherwise((sx + sy) / 2.0)
