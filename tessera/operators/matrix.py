"""Feature blocks and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks side by side by key: the first block's order and label stay."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*clash), keys, "left")


def parse_key(df: DataFrame, column: str) -> DataFrame:
    """``(qid, entity)`` written as text, in two columns."""
    inner = F.regexp_extract(column, r"^\(\s*([0-9]+)\s*,\s*(.*)\)$", 1)
    return df.withColumn("query_id", F.nullif(inner, F.lit("")).cast("bigint")).withColumn("entity", F.trim(F.regexp_replace(F.regexp_extract(column, r"^\(\s*([0-9]+)\s*,\s*(.*)\)$", 2), "^'|'$", "")))


def coalesce_zero(df: DataFrame, first: str, second: str) -> DataFrame:
    """The second column where it is not 0, else the first."""
    return df.withColumn(second, F.when(F.col(second) != 0, F.col(second)).otherwise(F.col(first)))


def quadratic(df: DataFrame, columns: list[str]) -> DataFrame:
    """A constant, the columns, and all their products of degree two, by name."""
    out = [F.lit(1.0).alias("bias"), *(F.col(c) for c in columns)]
    for i, a in enumerate(columns):
        out += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for b in columns[i:]]
    return df.select(*[c for c in df.columns if c not in columns], *out)


def subset(df: DataFrame, keep: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Columns taken in the order asked for, or all but some."""
    return df.select(*keep) if keep is not None else df.drop(*(without or []))


def labelled_json(cells: DataFrame, key: str) -> DataFrame:
    """A key's matrix as JSON: row and column labels, cells by place (from 1), and the highest value.

    ``cells``: key, row, col, value.
    """
    ranked = cells.withColumn("r", F.dense_rank().over(Window.partitionBy(key).orderBy("row"))).withColumn("c", F.dense_rank().over(Window.partitionBy(key).orderBy("col")))
    data = F.sort_array(F.collect_list(F.struct(F.col("r").alias("row"), F.col("c").alias("col"), F.col("value").alias("value"))))
    out = F.struct(F.sort_array(F.collect_set("row")).alias("hcrow"), F.sort_array(F.collect_set("col")).alias("hccol"), data.alias("data"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    return ranked.groupBy(key).agg(F.to_json(out).alias("json"))


def as_json(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """One JSON text for each row of a matrix: {row, cells: [{col, value}]}."""
    return cells.groupBy(row).agg(F.to_json(F.struct(F.col(row).alias("row"), F.sort_array(F.collect_list(F.struct(F.col(col).alias("col"), F.col(value).alias("value")))).alias("cells"))).alias("json"))
