"""Levels and tainted have no bound of depth."""

import pytest
from pyspark.sql import functions as F

from shapelake.operators import graph, provenance


@pytest.mark.parametrize("together", [1, 3, 50])
def test_parts_written_together_lose_nothing(spark, together):
    e = spark.range(7).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    v = spark.createDataFrame([(i,) for i in [*range(8), None]], "v bigint")
    assert {r.v: r.level for r in graph.levels(e, v, together).collect()} == {i: i for i in range(8)}
    rows = [("r", f"a{i}", "unknown" if i == 2 else "source_pixel", [f"a{i - 1}"] if i else [], True) for i in range(8)]
    a = spark.createDataFrame(rows, "run_id string, artifact_id string, origin string, parents array<string>, visible boolean")
    assert sorted(r.artifact_id for r in provenance.tainted(a, together).collect()) == [f"a{i}" for i in range(2, 8)]


class Stub:
    """A frontier that meets something new ``deep`` times, without running Spark."""

    def __init__(self, deep):
        self.left = deep

    def take(self, _):
        self.left -= 1
        return [1] if self.left >= 0 else []

    def __getattr__(self, _):
        return lambda *_args, **_kw: self


@pytest.mark.parametrize(("module", "run", "deep"), [(provenance, lambda s: provenance.tainted(s), 1500), (graph, lambda s: graph.levels(s, s), 10_500)])
def test_no_depth_is_cut(spark, monkeypatch, module, run, deep):
    stub = Stub(deep)
    monkeypatch.setattr(module, "materialize", lambda df, *_: df)
    run(stub)
    assert stub.left == -1  # asked until nothing was new
