"""The state of a run, written while it runs, where others can read it."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tessera.sources.workspace import hadoop_path


class Heartbeat:
    """Writes ``{state, done, total, beat}`` to ``path``: tasks done of those planned so far, by the jobs of one group."""

    def __init__(self, spark: SparkSession, path: str, group: str) -> None:
        self.spark, self.path, self.group, self.beats = spark, path, group, 0
        self.most = (0, 0)

    def tasks(self) -> tuple[int, int]:
        """(done, total) over the stages of the group's jobs; done never falls."""
        tracker = self.spark.sparkContext.statusTracker()
        tasks: dict[int, tuple[int, int]] = {}
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if x := tracker.getStageInfo(stage):
                    # A job that is over has skipped what it did not complete.
                    tasks[stage] = x.numCompletedTasks, x.numCompletedTasks if info.status == "SUCCEEDED" else x.numTasks
        self.most = max(self.most[0], sum(d for d, _ in tasks.values())), sum(n for _, n in tasks.values())
        return self.most

    def write(self, state: str) -> None:
        done, total = self.tasks()
        self.beats += 1
        hpath, files = hadoop_path(self.spark, self.path)
        stream = files.create(hpath, True)
        stream.write(bytearray(json.dumps({"state": state, "done": done, "total": total, "beat": self.beats, "at": time.time()}).encode()))
        stream.close()


@contextmanager
def heartbeat(spark: SparkSession, path: str, every: float = 5.0) -> Iterator[Heartbeat]:
    """Run what is inside as one job group and write its state at the start, every so many seconds, and at its end.

    The last state is ``finished`` or ``failed``.  Jobs that the block starts from other threads are not counted.
    """
    beat = Heartbeat(spark, path, uuid.uuid4().hex)
    context = spark.sparkContext
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(beat.group, path)
    over = threading.Event()

    def run() -> None:
        while not over.wait(every):
            beat.write("running")

    beat.write("running")
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    state = "failed"
    try:
        yield beat
        state = "finished"
    finally:
        over.set()
        thread.join()
        beat.write(state)
        for k, v in before.items():
            context.setLocalProperty(k, v)
