"""Sinks: PNG and SVG columns, run tables, text, JSON lines, CSV, and fail-open delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.kernels import codec, raster


def encode_png(images: DataFrame) -> DataFrame:
    """image_id, png, sha256 of decoded images (BGR(A) or gray bytes); an image without data gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not r["data"]:
                    out.append(None)
                    continue
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"])
                out.append(codec.encode_png(a[:, :, [2, 1, 0, 3][: r["n_channels"]]] if r["n_channels"] > 1 else a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "png"])

    done = images.select("image_id", "width", "height", "n_channels", "data").mapInArrow(run, "image_id string, png binary")
    return done.withColumn("sha256", F.sha2("png", 256))


def render(shapes: DataFrame, canvas: DataFrame) -> DataFrame:
    """Raster of every scene by painting its shapes in draw order.

    ``shapes``: image_id, z, kind, box array<double>, points array<struct<x,y>>, r, g, b; ``canvas``: image_id,
    width, height. Gives decoded images; where nothing is drawn they are transparent. A scene has a few dozen
    shapes by design; one task paints one scene.
    """
    per = shapes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("z", "kind", "box", "points", "r", "g", "b"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.zeros((row["height"], row["width"], 4), np.uint8)
                for s in row["s"] or []:
                    x, y, w, h = s["box"]
                    if s["kind"] in ("circle", "ellipse"):
                        m = raster.fill_ellipse(x + w / 2, y + h / 2, w / 2, h / 2, a.shape[:2])
                    else:
                        pts = [(p["x"], p["y"]) for p in s["points"] or []] or [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
                        m = raster.fill_polygon(np.array(pts), a.shape[:2])
                    a[m] = (s["b"], s["g"], s["r"], 255)
                yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]]), pa.array([row["width"]], pa.int32()), pa.array([row["height"]], pa.int32()), pa.array([4], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["image_id", "width", "height", "n_channels", "data"])

    return canvas.select("image_id", "width", "height").join(per, "image_id", "left").mapInArrow(run, "image_id string, width int, height int, n_channels int, data binary")


def shapes_svg(shapes: DataFrame, canvas: DataFrame) -> DataFrame:
    """SVG text of every scene, two decimals, in draw order; columns as for ``render``."""
    n = lambda c: F.format_string("%.2f", c)
    x, y, w, h = (F.col("box")[i] for i in range(4))
    fill = F.format_string(' fill="#%02x%02x%02x"/>', F.col("r"), F.col("g"), F.col("b"))
    pts = F.array_join(F.transform("points", lambda p: F.concat(n(p["x"]), F.lit(","), n(p["y"]))), " ")
    attr = lambda tag, **k: F.concat(F.lit(f"  <{tag}"), *[z for a, v in k.items() for z in (F.lit(f' {a}="'), n(v), F.lit('"'))], fill)
    element = (
        F.when(F.col("kind").isin("circle", "ellipse"), attr("ellipse", cx=x + w / 2, cy=y + h / 2, rx=w / 2, ry=h / 2))
        .when(F.size("points") >= 3, F.concat(F.lit('  <polygon points="'), pts, F.lit('"'), fill))
        .otherwise(attr("rect", x=x, y=y, width=w, height=h))
    )
    per = shapes.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", element.alias("e")))), lambda s: s["e"]), "\n").alias("body"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d">', "width", "height", "width", "height")
    return canvas.join(per, "image_id", "left").select("image_id", F.concat_ws("\n", head, "body", F.lit("</svg>")).alias("svg"))


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows as JSON lines with sorted keys, nulls kept: an observation log that grows by appending."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A flat report as CSV with header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_texts(df: DataFrame, path: str, key: str, text: str, parts: int | None = None) -> None:
    """Texts (SVG, JSON) under their keys, partition folders by a bounded number of key buckets."""
    n = parts or 64
    df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("bucket"), key, text).write.mode("overwrite").partitionBy("bucket").parquet(path)


def content_digest(df: DataFrame, key: list[str]) -> DataFrame:
    """One digest of a table per key: the sum of its rows' 64-bit hashes and their number, independent of row
    order and partitioning; two runs that agree give the same. Combines map-side."""
    rows = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    aggs = [F.count("*").alias("rows"), F.sum(rows).alias("digest")]
    return df.groupBy(*key).agg(*aggs) if key else df.agg(*aggs)


def deliver(events: DataFrame, send: Callable[[dict], str]) -> DataFrame:
    """Fail-open delivery: each event's state as ``send`` answers (STORED, PENDING, DUPLICATE, BLOCKED), or
    FAILED with the error's text. A failing receiver never fails the job. ``send`` gets the row as a dict."""
    cols = [f for f in events.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, errors = [], []
            for row in batch.to_pylist():
                try:
                    state = send(row)
                    ok = state in ("STORED", "PENDING", "DUPLICATE", "BLOCKED")
                    states.append(state if ok else "FAILED")
                    errors.append(None if ok else f"unknown answer {state}")
                except Exception as e:  # noqa: BLE001 - any failure of the receiver is an answer here
                    states.append("FAILED")
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "delivery", "delivery_error"])

    return events.mapInArrow(run, f"{ddl}, delivery string, delivery_error string")
