"""Resumable appends: only keys not seen before are worked on.

The stream is an extension: file arrival drives micro-batches, each an anti join and an append.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.writers import put_if_absent


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys), keys, "left_anti")


def follow(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Work on each micro-batch and put its rows where their keys are new; a rerun batch adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        put_if_absent(work(batch), out, keys)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_distinct(stream: DataFrame, out: str, keys: list[str], checkpoint: str, event_time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Append each key's first row; the keys seen so far are in Spark's state store, so a micro-batch reads new rows only.

    With ``event_time`` a key is remembered until the watermark is ``delay`` past it, else for good.
    Each batch writes a folder of its own, so a batch that is run again writes the same folder.
    """
    first = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys) if event_time else stream.dropDuplicates(keys)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return first.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
