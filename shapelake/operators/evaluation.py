"""Evaluation tables: feature survival, gaps between reports, distributions, corpus summaries, verdicts.

Nullable evidence stays nullable: an unavailable value is never averaged in, and a mean never overrides a
failed case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.operators.ranking import lagged

# The eight dimensions of a gap report.
DIMENSIONS = ["semantic_survival", "recognizability", "geometry_abstraction", "palette_role_preservation", "composition_negative_space", "primitive_economy", "orphan_contour_penalty", "feature_local_evidence"]


def feature_survival(features: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every manifest feature with its observed state and failure, and observations of unknown features.

    ``features``: case_id, feature_id, disposition; ``observed``: case_id, feature_id, state, source,
    confidence. What wasn't observed is 'unknown' from source 'missing'. A required feature fails unless
    present, a forbidden one unless absent.
    """
    keys = ["case_id", "feature_id"]
    rows = features.join(observed, keys, "left").withColumns({"state": F.coalesce("state", F.lit("unknown")), "source": F.coalesce("source", F.lit("missing"))})
    failed = ((F.col("disposition") == "required") & (F.col("state") != "present")) | ((F.col("disposition") == "forbidden") & (F.col("state") != "absent"))
    reason = F.when(failed, F.concat_ws("_", "disposition", F.lit("feature"), "state"))
    return rows.withColumn("failure", reason), observed.join(features, keys, "left_anti")


def case_gate(rows: DataFrame, key: str, failure: str) -> DataFrame:
    """PASS or FAIL per case with its sorted failures; no score takes part."""
    fails = F.array_sort(F.collect_list(failure))
    return rows.groupBy(key).agg(fails.alias("failures")).withColumn("gate", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))


def unpivot(df: DataFrame, key: list[str], names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per key and metric, values as double."""
    return df.unpivot(key, [F.col(n).cast("double").alias(n) for n in names], name, value)


def compare_metrics(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Metrics that both reports have: delta, and relative delta, null where the old value is 0 to 12 digits.

    ``old`` and ``new``: key columns, metric, value. Rows without a value drop out.
    """
    j = old.filter("value is not null").alias("o").join(new.filter("value is not null").alias("n"), [*key, "metric"])
    o, n = F.col("o.value"), F.col("n.value")
    return j.select(*key, "metric", o.alias("old_value"), n.alias("new_value"), (n - o).alias("delta"), F.when(F.abs(o) > 1e-12, (n - o) / F.abs(o)).alias("relative"))


def distributions(cases: DataFrame, entries: Column, key: str = "case_id") -> DataFrame:
    """Per diagnostic of a map<name, struct<status, value>>: available and unavailable counts, least, greatest."""
    rows = cases.select(key, F.explode(entries).alias("name", "d"))
    ok = F.col("d.status") == "AVAILABLE"
    return rows.groupBy("name").agg(
        F.count_if(ok).alias("available"), F.count_if(~ok | F.col("d.status").isNull()).alias("unavailable"), F.min(F.when(ok, F.col("d.value"))).alias("least"), F.max(F.when(ok, F.col("d.value"))).alias("greatest")
    )


def diagnostic_errors(cases: DataFrame, entries: Column, counts: list[str], key: str = "case_id") -> DataFrame:
    """Entries that break the record's rules: unknown status, no reason where unavailable, no finite value
    where available, a ratio outside 0..1, a count below 0 (``counts`` names the counts)."""
    rows = cases.select(key, F.explode(entries).alias("name", "d"))
    v = F.col("d.value")
    off = F.when(F.col("name").isin(counts), v < 0).otherwise((v < 0) | (v > 1))
    error = (
        F.when(F.col("d.status").isNull() | ~F.col("d.status").isin("AVAILABLE", "UNAVAILABLE"), "status")
        .when((F.col("d.status") == "UNAVAILABLE") & (F.coalesce(F.trim("d.reason"), F.lit("")) == ""), "reason")
        .when((F.col("d.status") == "AVAILABLE") & (v.isNull() | F.isnan(v)), "value")
        .when((F.col("d.status") == "AVAILABLE") & off, "range")
    )
    return rows.withColumn("error", error).filter("error is not null").select(key, "name", "error")


def corpus_summary(cases: DataFrame, key: list[str], case: str, passed: Column, minima: list[str], maxima: list[str]) -> DataFrame:
    """Least scores, greatest penalties (0 without cases), pass count and sorted failing cases of a corpus."""
    low = [F.coalesce(F.min(c), F.lit(0.0)).alias(f"min_{c}") for c in minima]
    high = [F.coalesce(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in maxima]
    aggs = [F.count("*").alias("cases"), F.count_if(passed).alias("passed"), *low, *high, F.array_sort(F.collect_list(F.when(~passed, F.col(case)))).alias("failing")]
    return df_agg(cases, key, aggs).withColumn("all_passed", (F.col("cases") > 0) & (F.col("cases") == F.col("passed")))


def df_agg(df: DataFrame, key: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*key).agg(*aggs) if key else df.agg(*aggs)


def verdicts(runs: DataFrame, key: list[str], order: list[str], score: str) -> DataFrame:
    """Each run's score against the run before: previous, delta, and improved, regressed, unchanged or
    (without predecessor) evaluated. ``order`` must be total within the key."""
    d = F.col(score) - F.col("previous")
    verdict = F.when(F.col("previous").isNull(), "evaluated").when(d > 0, "improved").when(d < 0, "regressed").otherwise("unchanged")
    return lagged(runs, key, order, score, "previous").withColumns({"delta": d, "verdict": verdict})


def ab_summary(pairs: DataFrame, key: list[str], before: Column, after: Column, worse: Column, guards: Column) -> DataFrame:
    """A/B decision: improved, regressed (by total or any dimension), guard failures, mean gain; ADOPT only if
    every case is accepted, none regressed and the mean gain is positive."""
    gain = before - after
    bad = (gain < 0) | worse
    ok = guards & ~worse & (gain > 0)
    out = df_agg(
        pairs,
        key,
        [F.count("*").alias("cases"), F.count_if(ok).alias("accepted"), F.count_if(gain > 0).alias("improved"), F.count_if(bad).alias("regressed"), F.count_if(~guards | worse).alias("guard_failures"), F.avg(gain).alias("mean_gain")],
    )
    adopt = (F.col("guard_failures") == 0) & (F.col("regressed") == 0) & (F.col("accepted") == F.col("cases")) & (F.col("mean_gain") > 0)
    return out.withColumn("decision", F.when(adopt, "ADOPT").otherwise("HOLD"))


def observation_summary(obs: DataFrame, key: list[str], run: str, applied: Column, reason: str, low: str, delta: Column) -> DataFrame:
    """Observations: distinct runs, candidates, adopted, rate (0 without any), counts of reasons of what wasn't
    applied, least ``low``, mean of ``delta`` over those that have one. Two combining aggregations."""
    base = df_agg(
        obs,
        key,
        [F.count_distinct(run).alias("runs"), F.count("*").alias("candidates"), F.count_if(applied).alias("adopted"), F.min(low).alias("least"), F.avg(delta).alias("mean_delta")],
    ).withColumn("rate", F.coalesce(F.try_divide(F.col("adopted"), F.col("candidates")), F.lit(0.0)))
    counts = obs.filter(~applied).groupBy(*key, reason).agg(F.count("*").alias("n"))
    why = df_agg(counts, key, [F.array_sort(F.collect_list(F.struct(F.col(reason).alias("reason"), "n"))).alias("reasons")])
    if not key:
        return base.withColumn("reasons", why.scalar())
    return base.join(why, key, "left")


def trend(before: Column, after: Column, tolerance: float) -> Column:
    """IMPROVED, REGRESSED, STABLE within the tolerance, UNAVAILABLE without both values."""
    d = after - before
    return F.when(d.isNull(), "UNAVAILABLE").when(d > tolerance, "IMPROVED").when(d < -tolerance, "REGRESSED").otherwise("STABLE")


def overall_trend(trends: Column) -> Column:
    """Of an array of trends: any regression rules, else any improvement, else stable only if all are."""
    return (
        F.when(F.array_contains(trends, "REGRESSED"), "REGRESSED")
        .when(F.array_contains(trends, "IMPROVED"), "IMPROVED")
        .when((F.size(trends) > 0) & F.forall(trends, lambda t: t == "STABLE"), "STABLE")
        .otherwise("UNAVAILABLE")
    )


def baseline_binding(evaluations: DataFrame, adoptions: DataFrame) -> DataFrame:
    """Evaluations with their adoption and the binding's links: equal source and baseline digests, different
    transactions, and whether candidate and baseline are the same bytes.

    ``evaluations``: evaluation_id, adoption_id, source_sha256, baseline_sha256, candidate_sha256,
    transaction_id; ``adoptions``: adoption_id, source_sha256, baseline_sha256. Without adoption: not bound.
    """
    j = evaluations.alias("e").join(adoptions.alias("a"), "adoption_id", "left")
    same = F.coalesce(F.col("e.transaction_id") == F.col("adoption_id"), F.lit(False))
    ok = (F.col("e.source_sha256") == F.col("a.source_sha256")) & (F.col("e.baseline_sha256") == F.col("a.baseline_sha256")) & ~same
    return j.select("e.evaluation_id", "adoption_id", same.alias("same_transaction"), (F.col("e.candidate_sha256") == F.col("e.baseline_sha256")).alias("equal_bytes"), F.coalesce(ok, F.lit(False)).alias("bound"))
