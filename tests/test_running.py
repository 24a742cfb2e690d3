"""Heartbeats while a job runs, and deduplication that reads new rows only."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.streaming.heartbeat import heartbeat
from tessera.streaming.incremental import follow_distinct


def test_states_are_written_while_a_job_runs(spark, tmp_path):
    path, seen = tmp_path / "state.json", []
    slow = F.udf(lambda x: (time.sleep(0.25), x)[1], "long")
    with heartbeat(spark, f"file://{path}", every=0.2) as beat:
        true = beat.write
        beat.write = lambda state: (true(state), seen.append(json.loads(path.read_text())))
        spark.range(0, 24, 1, 8).select(slow("id").alias("x")).agg(F.sum("x")).collect()
    last = json.loads(path.read_text())
    assert last["state"] == "finished" and last["done"] == last["total"] >= 8
    running = [s for s in seen if s["state"] == "running"]
    assert len({s["done"] for s in running}) >= 2 and [s["beat"] for s in seen] == sorted(s["beat"] for s in seen)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(ZeroDivisionError), heartbeat(spark, f"file://{path}"):
        1 / 0
    assert json.loads(path.read_text())["state"] == "failed"


def test_each_batch_reads_new_rows_only(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def put(rows):
        spark.createDataFrame(rows, "k int, v string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("k int, v string, at timestamp").parquet(str(source))
        q = follow_distinct(stream, str(out), ["k"], str(tmp_path / "cp"))
        assert q.awaitTermination(120) and q.exception() is None
        return sum(p.numInputRows for p in q.recentProgress)

    from datetime import datetime as dt

    put([(k, "a", dt(2024, 1, 1)) for k in range(50)] + [(3, "b", dt(2024, 1, 1))])
    assert run() == 51
    put([(3, "again", dt(2024, 1, 2)), (60, "c", dt(2024, 1, 2))])
    assert run() == 2
    got = spark.read.parquet(str(out))
    assert got.count() == 51 and got.where("k = 60").count() == 1 and {p.name for p in Path(out).iterdir() if p.name.startswith("batch=")} == {"batch=0", "batch=1"}


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    from datetime import datetime as dt

    source = tmp_path / "in"
    for day in (1, 2, 20, 21):
        spark.createDataFrame([(1, dt(2024, 1, day))], "k int, at timestamp").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k int, at timestamp").parquet(str(source))
        assert follow_distinct(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "cp"), "at", "5 days").awaitTermination(120)
    # The watermark moves after a batch: day 20 still meets the key of day 1, day 21 no longer does.
    assert [r.at.day for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()] == [1, 21]
