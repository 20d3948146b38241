"""Streams read file by file against what the whole table gives."""

import datetime as dt

from aulos.streaming import jobs

SCHEMA = "job_id long, state string, ts timestamp, value double"
NOON = dt.datetime(2024, 1, 1, 12, 0)


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        table = [(j, s, NOON + dt.timedelta(minutes=m), v) for j, s, m, v in rows]
        spark.createDataFrame(table, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def finish(df, tmp_path):
    query = jobs.append_available(df, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120) and query.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_summary_of_closed_windows(spark, tmp_path):
    source = stream(spark, tmp_path, [[(1, "queued", 1, 2.0), (2, "queued", 3, 4.0), (3, "done", 4, 1.0)], [(4, "queued", 300, 9.0)]])
    rows = {(r.start, r.state): (r.jobs, r.mean_value) for r in finish(jobs.queue_summary(source), tmp_path).collect()}
    assert rows[(NOON, "queued")] == (2, 3.0) and rows[(NOON, "done")] == (1, 1.0)


def test_each_key_is_enqueued_once(spark, tmp_path):
    source = stream(spark, tmp_path, [[(1, "a", 0, 0.0), (2, "a", 1, 0.0), (3, "b", 1, 0.0)], [(4, "a", 5, 0.0)]])
    out = finish(jobs.enqueue_once(source, "state"), tmp_path).collect()
    assert sorted(r.state for r in out) == ["a", "b"]


def test_only_jobs_without_an_end_are_stuck(spark, tmp_path):
    source = stream(spark, tmp_path, [[(1, "running", 0, 0.0), (2, "running", 0, 0.0), (3, "running", 20, 0.0)], [(2, "done", 19, 0.0)], [(9, "done", 45, 0.0)], [(10, "done", 46, 0.0)]])
    out = finish(jobs.stuck_jobs(source, late="2 minutes"), tmp_path).collect()
    assert [(r.job_id, r.started) for r in out] == [(1, NOON)]
