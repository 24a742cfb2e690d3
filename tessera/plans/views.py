"""The driver's tables in the roles of the linking workload, in Spark and, alike, in SQL.

A query is an order; its candidates are the order's parts with the price as prior; the gold row is
the first to ship.  Documents of one language and source are the candidates of one token group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.readers import dealt_rows, parquet

GROUP = ["lang", "source"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, entity, supplier, prior, score, pos, label."""
    rows = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = dealt_rows(rows, rows.count(), "l_orderkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").alias("prior"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("score"), pos.alias("pos"), (first == 1).cast("int").alias("label"))


CANDIDATES = """(SELECT l_orderkey AS query_id, l_partkey AS entity, l_suppkey AS supplier, l_extendedprice AS prior, l_extendedprice / l_quantity AS score,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity)::INTEGER AS pos,
    (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity) = 1)::INTEGER AS label FROM lineitem)"""

TOKENS = r"(SELECT lang, source, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents)"
PLACED = r"(SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links from orders to parts, dealt by their source, where they meet."""
    return parquet(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).repartition("src").distinct()


EDGES = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a supplier's nation ("document") are too many; parts of one order cohere: each line is a mention."""
    rows = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = dealt_rows(rows, rows.count(), "l_orderkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), pos.alias("query_id"), F.col("l_partkey").alias("entity"))


PAIRED = """(SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity)::INTEGER AS query_id, l_partkey AS entity FROM lineitem)"""
