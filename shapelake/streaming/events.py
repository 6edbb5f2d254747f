"""Evaluation events as a stream: duplicates dropped within a watermark, verdict against the score before.

The batch form of the verdict is ``operators.evaluation.verdicts``; both give the same rows for the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id string, case_id string, run_id string, occurred_at timestamp, score double, gate string"
VERDICT = "event_id string, case_id string, run_id string, occurred_at timestamp, score double, previous double, delta double, verdict string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of JSON-lines event files as a stream; each trigger takes a bounded number of files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each: repeats of an event_id within the watermark drop out, state older than it is freed."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else None
    out = []
    for pdf in frames:
        for r in pdf.sort_values(["occurred_at", "event_id"]).itertuples(index=False):
            delta = None if previous is None else r.score - previous
            verdict = "evaluated" if delta is None else "improved" if delta > 0 else "regressed" if delta < 0 else "unchanged"
            out.append((r.event_id, r.case_id, r.run_id, r.occurred_at, r.score, previous, delta, verdict))
            previous = r.score
    if previous is not None:
        state.update((previous,))
    yield pd.DataFrame(out, columns=["event_id", "case_id", "run_id", "occurred_at", "score", "previous", "delta", "verdict"]).astype({"previous": "float64", "delta": "float64"})


def stream_verdicts(events: DataFrame) -> DataFrame:
    """Verdict of each event against its case's score before, in order of arrival (within a trigger, of time).
    The state is one number per case."""
    return events.groupBy("case_id").applyInPandasWithState(_judge, VERDICT, "score double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events, failed gates and mean score per time window; late events within the delay count."""
    window = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    e = events.withWatermark("occurred_at", delay)
    return e.groupBy(window.alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("gate") == "FAIL").alias("failed"), F.avg("score").alias("mean_score")).select("w.start", "w.end", "events", "failed", "mean_score")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, write Parquet, stop; run again it takes up where it left off."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
