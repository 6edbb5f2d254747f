from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shapelake.operators import evaluation
from shapelake.streaming import events as E

T0 = datetime(2025, 1, 1)


def rows():
    return [(f"e{i}", f"c{i % 3}", f"r{i}", T0 + timedelta(hours=i), (i * 7 % 5) / 5.0, "FAIL" if i % 4 == 0 else "PASS") for i in range(24)]


def write(spark, part, path):
    spark.createDataFrame(part, E.EVENT).coalesce(1).write.mode("append").json(path)


def test_stream_equals_batch(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    first, second = rows()[:12], rows()[12:]
    write(spark, first + first[:3], src)  # delivered again
    stream = lambda: E.stream_verdicts(E.distinct_events(E.read_events(spark, src), "100 days"))
    E.run_once(stream(), out, cp)
    write(spark, second + first[:1], src)
    E.run_once(stream(), out, cp)
    got = {(r.event_id, r.previous, r.verdict) for r in spark.read.parquet(out).collect()}
    batch = evaluation.verdicts(spark.createDataFrame(rows(), E.EVENT), ["case_id"], ["occurred_at", "event_id"], "score")
    assert got == {(r.event_id, r.previous, r.verdict) for r in batch.collect()} and len(got) == 24


def test_windows_count_like_batch(spark, tmp_path):
    src, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    late = ("z", "c", "r", T0 + timedelta(days=30), 0.0, "PASS")  # moves the watermark past all windows
    write(spark, rows(), src)
    E.run_once(E.windowed_counts(E.read_events(spark, src), "6 hours"), out, cp)
    write(spark, [late], src)
    E.run_once(E.windowed_counts(E.read_events(spark, src), "6 hours"), out, cp)
    write(spark, [late], src)
    E.run_once(E.windowed_counts(E.read_events(spark, src), "6 hours"), out, cp)
    got = {(r.start, r.events, r.failed) for r in spark.read.parquet(out).collect()}
    df = spark.createDataFrame(rows(), E.EVENT).groupBy(F.window("occurred_at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("gate") == "FAIL").alias("f"))
    assert got == {(r.w.start, r.n, r.f) for r in df.collect()}
