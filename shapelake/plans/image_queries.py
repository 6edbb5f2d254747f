"""The image pipelines as queries, on pictures drawn from whole test tables.

A picture is the brands that share their first digit; every part is a rectangle whose place, size and
color follow from its key, larger ones behind. There is no SQL for them: what they do is tested on known pictures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.kernels import lines
from shapelake.operators import pixels
from shapelake.plans import images
from shapelake.session import table

WIDTH, HEIGHT = 160, 120
IMAGE = "image_id string, width int, height int, n_channels int, data binary"


def drawn(rows: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Pictures of rectangles: ``rows`` has image_id and key; rows of an image meet in one task, as its picture must."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.sort(pdf["key"].to_numpy())
        a = np.full((height, width, 3), (235, 225, 210), np.uint8)
        w, h = 6 + k * 13 % (width // 3), 6 + k * 29 % (height // 3)
        for i in np.argsort(-(w * h), kind="stable"):
            x, y = k[i] * 37 % width, k[i] * 53 % height
            a[y : y + h[i], x : x + w[i]] = (40 + k[i] % 6 * 40, 30 + k[i] % 5 * 50, 60 + k[i] % 4 * 60)
        return pd.DataFrame([(pdf["image_id"].iat[0], width, height, 3, a[:, :, ::-1].tobytes())], columns=["image_id", "width", "height", "n_channels", "data"])

    return rows.groupBy("image_id").applyInPandas(draw, IMAGE)


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    return drawn(table(spark, folder, "part").select(F.substring("p_brand", 1, 7).alias("image_id"), F.col("p_partkey").alias("key")))


def q_image_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Color strip of every picture."""
    return images.color_strip(pixels.to_pixels(pictures(spark, folder)), count=6, feature=True).drop("c")


def q_image_palette(spark: SparkSession, folder: str) -> DataFrame:
    """Role colors of every picture."""
    return images.feature_palette(pictures(spark, folder)).select("image_id", "rank", "r", "g", "b", "share", "family", "role")


def q_image_stable(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of the stable abstraction of every picture, at its own size."""
    return images.stable_scene(pictures(spark, folder), shapes=24, side=None)["shapes"].select("image_id", "region_id", "kind", "layer", "role", "z", "iou")


def q_image_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the nested cuts of every picture's merge forest, at its own size."""
    cuts = images.hierarchical_scene(pictures(spark, folder), (8, 16, 32), 120, None)["cuts"]
    return cuts.groupBy("image_id", "wanted").agg(F.count_distinct("node").alias("regions"), F.count("*").alias("superpixels"))


def q_image_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line support and facets of every picture."""

    def measure(image_id, rgb, alpha):
        yield {"image_id": image_id, **lines.line_support(rgb), **lines.macro_facets(rgb)}

    return images.per_image(pictures(spark, folder), measure, "image_id string, edge_density double, support double, lines int, facets int, large_share double, mean_corners double")


QUERIES = {f.__name__: f for f in (q_image_strip, q_image_palette, q_image_stable, q_image_hierarchy, q_image_lines)}
SQL: dict[str, str] = {}
