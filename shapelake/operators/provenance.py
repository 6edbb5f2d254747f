"""Artifact lineage: duplicate ids, missing parents, cycles, and origins that taint what follows.

artifacts: run_id, artifact_id, origin, parents array<string>, visible (boolean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.operators.graph import levels
from shapelake.session import materialize

# Origins that nothing visible may descend from.
FORBIDDEN = ["synthesized", "unknown"]


def _nodes(a: DataFrame) -> DataFrame:
    return a.select(F.struct("run_id", "artifact_id").alias("v"))


def _edges(a: DataFrame) -> DataFrame:
    """parent -> child within a run."""
    e = a.select("run_id", "artifact_id", F.explode("parents").alias("parent"))
    return e.select(F.struct("run_id", F.col("parent").alias("artifact_id")).alias("a"), F.struct("run_id", "artifact_id").alias("b"))


def tainted(artifacts: DataFrame, together: int = 50) -> DataFrame:
    """Artifacts of forbidden origin and all that descend from them (run_id, artifact_id): a frontier that moves
    along the edges until it meets nothing new, one join a step. What was seen is written together after every
    ``together`` steps, so plans stay short however deep the lineage."""
    edges = materialize(_edges(artifacts).distinct(), "lineage")
    bad = artifacts.filter(F.lower("origin").isin(FORBIDDEN) | F.col("origin").isNull())
    seen = front = materialize(_nodes(bad).distinct(), "tainted")
    step = 0
    while True:
        nxt = edges.join(front.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v")).distinct()
        front = materialize(nxt.join(seen, "v", "left_anti"), "tainted")
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        step += 1
        if step % together == 0:
            seen = materialize(seen, "tainted")
    return seen.select("v.run_id", "v.artifact_id").distinct()


def violations(artifacts: DataFrame) -> DataFrame:
    """What breaks a run's provenance: run_id, artifact_id, violation."""
    row = lambda df, what: df.select("run_id", "artifact_id", F.lit(what).alias("violation"))
    twice = artifacts.groupBy("run_id", "artifact_id").count().filter("count > 1")
    one = artifacts.dropDuplicates(["run_id", "artifact_id"])
    lost = _edges(one).join(_nodes(one).withColumnRenamed("v", "a"), "a", "left_anti").select("b.run_id", "b.artifact_id").distinct()
    known = _edges(one).join(_nodes(one).withColumnRenamed("v", "a"), "a", "left_semi")
    cyclic = levels(known, _nodes(one)).filter("level is null").select("v.run_id", "v.artifact_id")
    dirty = one.filter("visible").join(tainted(one), ["run_id", "artifact_id"], "left_semi")
    return row(twice, "duplicate id").unionByName(row(lost, "missing parent")).unionByName(row(cyclic, "cycle")).unionByName(row(dirty, "forbidden lineage"))
