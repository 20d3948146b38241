"""Structured Streaming forms of the job queries, over rows (job_id, state, ts timestamp, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def queue_summary(jobs: DataFrame, every: str = "10 minutes", late: str = LATE) -> DataFrame:
    """start, state, jobs, mean_value of each window; rows later than ``late`` are left out."""
    grouped = jobs.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "state")
    return grouped.agg(F.count(F.lit(1)).alias("jobs"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "state", "jobs", "mean_value")


def enqueue_once(requests: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The first request of each key; keys are forgotten ``late`` after their first request."""
    return requests.withWatermark("ts", late).withColumn("job_key", F.md5(F.col(key))).dropDuplicatesWithinWatermark(["job_key"])


def stuck_jobs(jobs: DataFrame, minutes: int = 30, late: str = LATE) -> DataFrame:
    """job_id, started of jobs that were 'running' for more than ``minutes`` of event time without an end.

    The state is one timestamp a running job; it goes with the job's end or its alarm.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "started_ms": [started]})
            return
        rows = pd.concat(list(batches))
        if (rows["state"] != "running").any():
            if state.exists:
                state.remove()
            return
        started = int(rows["ms"].min())
        if state.exists:
            started = min(started, state.get[0])
        state.update((started,))
        state.setTimeoutTimestamp(max(started + minutes * 60000, state.getCurrentWatermarkMs() + 1))

    # milliseconds since the epoch, so the session's time zone plays no part
    keyed = jobs.withWatermark("ts", late).select("job_id", "state", "ts", F.unix_millis("ts").alias("ms")).groupBy("job_id")
    found = keyed.applyInPandasWithState(run, "job_id long, started_ms long", "started_ms long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("job_id", F.timestamp_millis("started_ms").alias("started"))


def append_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files; a restart goes on from ``checkpoint`` and writes nothing twice."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
