"""Shards by vector bin packing: bytes, tokens and rows balanced together.

Rows with equal text form a group with a vector (bytes, tokens, rows); a group is placed whole, in the
shard where the dot product of its vector with what is left of the shard's capacity is highest.
Groups of more than LARGE_SHARE of a shard, of which there are at most shards / LARGE_SHARE, are
placed first and in one sequence, largest first.  The others are packed in lanes of about
LANE_GROUPS groups side by side: each lane takes its own part of what is left of every shard, so no
lane waits for another and their number grows with the table.

Only a group of more than WHOLE_SHARE of a shard is cut, since the law could not hold with it: into
pieces of PIECE_SHARE of a shard by a hash of the ids.

The law is ``bytes``: sums of sizes come out near equal, rows and tokens as near as that allows.

Edge cases: a null text has no bytes (size 1, CRC 0) and is a group like any other; an empty table
gives no rows; ids may be null or repeat: slots then follow size and CRC, and equal rows are
interchangeable; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import cut, drop, shuffle_partitions

LANE_GROUPS = 512
WHOLE_SHARE, PIECE_SHARE, LARGE_SHARE = 1 / 2, 1 / 64, 1 / 512
DIMENSIONS = ("bytes", "tokens", "rows")
#: Bytes weigh most, since they are the law.
WEIGHTS = np.array([8.0, 1.0, 1.0])


def pack(vectors: np.ndarray, left: np.ndarray, unit_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each vector and what is left of each: largest first, highest dot product with the residual.

    ``left`` (shards, dimensions) and the vectors are measured in ``unit_of`` each dimension.
    """
    unit, left = vectors / unit_of * WEIGHTS, left * WEIGHTS
    out = np.zeros(len(vectors), np.int32)
    for k in np.argsort(-unit.sum(axis=1), kind="stable").tolist():
        s = int((left @ unit[k]).argmax())
        out[k] = s
        left[s] -= unit[k]
    return out, left / WEIGHTS


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("text_key"),
        )
    )
    totals = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not totals["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = totals["bytes"] / shards
    lanes = max(1, totals["rows"] // LANE_GROUPS)
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("text_key").agg(*sums)
    torn = groups.where(F.col("bytes") > share * WHOLE_SHARE).select("text_key", F.least(F.ceil(F.col("bytes") / F.lit(max(1.0, share * PIECE_SHARE))), F.col("rows")).cast("long").alias("pieces"))
    keyed = rows.join(F.broadcast(torn), "text_key", "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("pieces"))).otherwise(F.lit(0)).cast("long"))
    items = cut(keyed.groupBy("text_key", "piece").agg(*sums).withColumn("lane", F.pmod(F.xxhash64("text_key", "piece"), F.lit(lanes)).cast("long")))
    # At most shards / LARGE_SHARE items are larger than that share of a shard.
    large = items.where(F.col("bytes") > share * LARGE_SHARE).orderBy("text_key", "piece").toPandas()
    per_shard = np.maximum([totals[d] / shards for d in DIMENSIONS], 1e-9)
    at, left = pack(large[list(DIMENSIONS)].to_numpy(float), np.ones((shards, len(DIMENSIONS))), per_shard)
    # What is left of a shard is its part of every lane.
    parts = np.maximum(left, 0) + 1e-12
    parts /= parts.mean(axis=0)

    def pack_lane(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("text_key", "ascending"), ("piece", "ascending")])
        vectors = np.stack([table[d].to_numpy().astype(float) for d in DIMENSIONS], axis=1)
        # Ties go to another shard in each lane.
        turn = np.roll(np.arange(shards), int(key[0].as_py()) % shards)
        found, _ = pack(vectors, parts[turn], np.maximum(vectors.sum(axis=0) / shards, 1e-9))
        return table.append_column("shard", pa.array(turn[found], pa.int32())).select(["text_key", "piece", "shard"])

    small = items.where(F.col("bytes") <= share * LARGE_SHARE).groupBy("lane").applyInArrow(pack_lane, "text_key string, piece long, shard int")
    first = spark.createDataFrame([(k, int(p), int(s)) for k, p, s in zip(large["text_key"], large["piece"], at)], "text_key string, piece long, shard int")
    placed = cut(small.unionByName(first))
    sharded = keyed.select("doc_id", "size", "text_crc32", "text_key", "piece").join(placed, ["text_key", "piece"]).drop("text_key", "piece")
    out = cut(sharded)
    drop(rows, items, placed)
    return numbered(out, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``slot``, from 0 without gaps in each shard, numbered bucket by bucket."""
    buckets = max(8, 4 * shuffle_partitions(rows.sparkSession) // shards)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()
    before = counts.withColumn("offset", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.select("shard", "bucket", F.coalesce("offset", F.lit(0)).alias("offset")))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("within", within).join(before, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("within") - 1).drop("within", "offset", "bucket")
