"""Intermediate tables of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

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


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the JVM has them."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession) -> str:
    """A path that nothing stands at; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    hpath, files = hadoop_path(spark, path)
    files.deleteOnExit(hpath)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once and read as often as it is used; it goes with ``drop`` or when the driver's JVM ends."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` whose last reader has been written."""
    for df in tables:
        hpath, files = hadoop_path(df.sparkSession, df.stored_at)
        files.delete(hpath, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a job shuffles goes from the disks when the job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
