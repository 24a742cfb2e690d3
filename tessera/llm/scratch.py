"""Intermediate tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where all of Spark runs in one process on one machine and no folder is named, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without it a default in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    A lost executor costs at most the steps after this table.  The table goes with ``drop``, or
    when the driver's JVM ends (``FileSystem.deleteOnExit``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hpath, files = _hadoop_path(spark, path)
    files.deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` whose last reader has been written."""
    for df in tables:
        hpath, files = _hadoop_path(df.sparkSession, df.scratch_path)
        files.delete(hpath, True)


#: Rows of a few longs that a broadcast holds at most.
BROADCAST_ROWS = 1 << 21


def by_list(wide: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """``wide`` joined to a written list of keys, without a shuffle of ``wide`` where the list is small.

    The list is counted first: up to BROADCAST_ROWS rows are broadcast, more meet in a shuffled join.
    """
    return wide.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


#: Rows in an Arrow batch, at most: a batch of long texts stands in memory several times over.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to BATCH_ROWS."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
