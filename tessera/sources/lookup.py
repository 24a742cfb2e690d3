"""Tables for point lookups: files by hash of the key, so that a lookup opens the files of its keys only.

A table is partitioned by bucket, a digest of its key modulo a number that stands in its folder's name;
keys given as values prune buckets while the query is planned, keys given as a table prune them while it
runs.  Inside a file rows are sorted and have Bloom filters, which skip row groups without the key.

Edge cases: null keys are a bucket's rows like others and are found by none of the lookups; a key that
many rows share makes a large bucket, which is written in files of at most FILE_ROWS rows; unknown keys
are left out, or come with the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
FILE_ROWS = 5_000_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_indexed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write ``df`` for lookups by ``key``."""
    kind = df.schema[key].dataType.simpleString()
    placed = df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, key)
    writer = placed.write.partitionBy(BUCKET).option("maxRecordsPerFile", FILE_ROWS).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(f"{path}/key={key}-{kind}-{buckets}")


class Lookup:
    """A table of ``write_indexed``."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, buckets: int = 64) -> None:
        self.key, self.kind, self.buckets = key, kind, buckets
        self.table = spark.read.parquet(f"{path}/key={key}-{kind}-{buckets}")

    def values(self, keys: Sequence) -> DataFrame:
        """The rows of some keys; of no keys, none."""
        if not keys:
            return self.table.limit(0).drop(BUCKET)
        typed = [F.lit(k).cast(self.kind) for k in dict.fromkeys(keys)]
        inside = F.col(BUCKET).isin([bucket_of(k, self.buckets) for k in typed])
        return self.table.where(inside & F.col(self.key).isin(typed)).drop(BUCKET)

    def joined(self, keys: DataFrame, default: dict | None = None) -> DataFrame:
        """``keys`` (with a column named as the key) beside their rows; with ``default`` unknown keys come with its values."""
        asked = keys.withColumn(BUCKET, bucket_of(F.col(self.key).cast(self.kind), self.buckets))
        out = asked.join(self.table, [BUCKET, self.key], "left" if default is not None else "inner").drop(BUCKET)
        return out if default is None else out.fillna(default)

    def value(self, key, column: str, default=None):
        """One value of one key's first row, or the default."""
        row = self.values([key]).select(column).first()
        return default if row is None or row[0] is None else row[0]
