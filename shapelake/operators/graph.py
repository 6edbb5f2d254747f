"""Graphs as edge tables: connected components, levels, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.session import materialize


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """Component of every vertex: the least vertex id of it. ``edges``: a, b; ``vertices``: v (adds lone ones).

    Alternating large-star and small-star steps: each round rewires every vertex to the least of its
    neighbourhood, which ends after a number of rounds logarithmic in practice. A step is one combining
    aggregation and one join on a vertex. The aggregates are written before they are joined: both sides of the
    join are then plain shuffles, and AQE can split a hub that holds a third of all edges. Each round is
    written to the shared folder, so lineage stays short and nothing is kept on one machine. Null ends and
    loops are no edges. Raises if ``rounds`` don't suffice.
    """
    pairs = materialize(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if not pairs.take(1):
        lone = vertices if vertices is not None else edges.select(F.col("a").alias("v")).filter("false")
        return lone.select("v", F.col("v").alias("component")).distinct()
    now = _summary(pairs)
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        # large star: greater neighbours go to the least of the neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: a vertex and its lesser neighbours go to the least of them
        large = materialize(large, "cc")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        new = materialize(small, "cc")
        pairs, before, now = new, now, _summary(new)
        if now == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    member = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component")
    roots = member.select(F.col("component").alias("v")).distinct().select("v", F.col("v").alias("component"))
    out = member.unionByName(roots)
    if vertices is not None:
        lone = vertices.select("v").distinct().join(out, "v", "left_anti")
        out = out.unionByName(lone.select("v", F.col("v").alias("component")))
    return out


def _summary(pairs: DataFrame) -> tuple:
    """Count and sums of two digests of distinct pairs: tables that differ share them with probability 2^-96."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    return tuple(pairs.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.hash("v", "u"))).first())


def levels(edges: DataFrame, vertices: DataFrame, together: int = 50) -> DataFrame:
    """Level of every vertex of a directed graph (edges a -> b): the longest path into it; vertices on a cycle,
    or after one, get null; a null is no vertex. Works level by level (Kahn), each level one anti-join, until no
    vertex is ready; the levels so far are written together after every ``together``, so plans stay short
    however deep the graph."""
    left = materialize(vertices.filter("v is not null").select("v").distinct(), "levels")
    open_ = materialize(edges.select("a", "b").filter("a != b").distinct(), "levels")
    loops = edges.filter("a = b").select(F.col("a").alias("v"))
    out, depth = None, 0
    while True:
        ready = left.join(open_.select(F.col("b").alias("v")), "v", "left_anti").join(loops, "v", "left_anti")
        ready = materialize(ready, "levels")
        if not ready.take(1):
            break
        done = ready.select("v", F.lit(depth).alias("level"))
        out = done if out is None else out.unionByName(done)
        left = materialize(left.join(ready, "v", "left_anti"), "levels")
        open_ = materialize(open_.join(ready.withColumnRenamed("v", "a"), "a", "left_anti"), "levels")
        depth += 1
        if depth % together == 0:
            out = materialize(out, "levels")
    rest = left.select("v", F.lit(None).cast("int").alias("level"))
    return rest if out is None else out.unionByName(rest)


def unknown_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge ends that are no vertices, once each."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    return ends.join(vertices.select("v"), "v", "left_anti")
