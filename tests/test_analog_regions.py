"""Region queries over made tables."""

import re

from pyspark.sql import functions as F

from shapelake.plans import analog_regions


def test_touching_regions_meet_by_stretches_of_keys(spark):
    keys = {"a": [-61, -60, -1, 0, 1, 59, 60, 61, 119, 120, 180, 2**53 + 1, 2**53 + 61], "b": [0, 60, 121], "c": [5]}
    r = spark.createDataFrame([(i, k) for i, ks in keys.items() for k in ks], "image_id string, region_id bigint")
    got = [(p.image_id, p.a, p.b) for p in analog_regions._touching(r).select("image_id", "a", "b").collect()]
    want = {(i, p, q) for i, ks in keys.items() for p in ks for q in ks if 1 <= q - p <= 60}
    assert len(got) == len(want) and set(got) == want


def test_touching_regions_of_a_large_image_are_not_all_compared(spark):
    r = spark.range(1000).select((F.col("id") % 1).alias("image_id"), F.col("id").alias("region_id"))
    d = analog_regions._touching(r)
    keys = re.findall(r"Join \[image_id#\d+L, (\w+)#", d._jdf.queryExecution().executedPlan().toString())
    assert keys, "regions meet by the image alone: every region of an image with every other"
    assert d.count() == sum(min(60, 999 - k) for k in range(1000))
