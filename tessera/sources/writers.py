"""Sinks: appends partitioned by run, put-if-absent, exports, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append_processed(rows: DataFrame, path: str, done: str, key: str, *partitions: str) -> None:
    """Append rows, then mark their keys as processed: a failure between the two only repeats work."""
    append(rows, path, *partitions)
    put_if_absent(rows.select(key), done, [key])


def put(df: DataFrame, path: str, keys: list[str], target: str) -> None:
    """Set, list or hash put: the table with ``df``'s rows in place of those with the same keys, written to ``target``."""
    old = df.sparkSession.read.parquet(path)
    old.join(df.select(*keys), keys, "left_anti").select(*df.columns).unionByName(df).write.mode("overwrite").parquet(target)


def bulk_load(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """Append in files of at most ``rows`` rows."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def without(df: DataFrame, condition) -> DataFrame:
    """A DELETE as a new version of the table; rows for which the condition is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def put_if_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table does not hold; of equal keys in ``df`` one goes in."""
    new = df.dropDuplicates(keys)
    if exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    new.write.mode("append").parquet(path)


def updated(df: DataFrame, condition, column: str, value) -> DataFrame:
    """An UPDATE as a new version of the table, to be written elsewhere and swapped in."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def copy(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("append").parquet(target)


def json_export(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def csv_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def gold_predictions(df: DataFrame) -> DataFrame:
    """Labelled rows in the place of predictions, to see what a perfect ranker would give."""
    return df.where("label <> 0").select("doc_id", "query_id", F.lit(1).alias("rank"), "entity", "score")


def predictions_by_document(ranked: DataFrame, k: int) -> DataFrame:
    """Each document's predicted entities with their queries, as one JSON text."""
    rows = ranked.where(F.col("rank") <= k)
    return rows.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("query_id", "rank", "entity")))).alias("predictions"))


def predictions_by_mention(ranked: DataFrame, k: int) -> DataFrame:
    """Each mention's candidate filter: entities with their scores, best first, as one JSON text."""
    rows = ranked.where(F.col("rank") <= k)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("rank", "entity", "score"))), lambda x: F.struct(x["entity"].alias("entity"), x["score"].alias("score")))
    return rows.groupBy("query_id").agg(F.to_json(cells).alias("filter"))


def run_status(done: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """How many keys are worked off, of how many: what a heartbeat reports."""
    total = every.agg(F.count_distinct(key).alias("total"))
    return done.agg(F.count_distinct(key).alias("done")).crossJoin(total).withColumn("percent", F.try_divide(100.0 * F.col("done"), F.col("total")))


def html_table(df: DataFrame, columns: list[str], order: list) -> DataFrame:
    """One HTML table row for each row of ``df``, headed by the columns' names."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    body = df.select(*order, F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>")).alias("html"))
    return body


def publish_predictions(ranked: DataFrame, path: str, k: int) -> None:
    """predictions(doc_id, query_id, rank, entity, score), the first k of each query."""
    ranked.where(F.col("rank") <= k).select("doc_id", "query_id", "rank", "entity", "score").write.mode("overwrite").parquet(path)
