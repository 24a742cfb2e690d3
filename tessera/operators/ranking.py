"""Ranking, argmax and scaling in groups.  Every order is total: the score, then the place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Each group's first k rows, with ``rank`` from 1."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def argmax(df: DataFrame, key: str, score: str, pos: str, value: str) -> DataFrame:
    """The value with the highest score, the first on ties: an aggregate, no sort of the groups."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(F.col(score), -F.col(pos))).alias(value), F.max(score).alias(score))


def score_gaps(df: DataFrame, key: str, score: str, pos: str, k: int = 3) -> DataFrame:
    """The leader's score and exp(s_j - s_0) for the next k rows."""
    top = top_k(df, [key], [F.desc(score), F.asc(pos)], k + 1)
    first = F.max(F.when(F.col("rank") == 1, F.col(score)))
    out = top.groupBy(key).agg(first.alias("top"), *(F.max(F.when(F.col("rank") == j + 1, F.col(score))).alias(f"s{j}") for j in range(1, k + 1)))
    return out.select(key, "top", *(F.exp(F.col(f"s{j}") - F.col("top")).alias(f"gap{j}") for j in range(1, k + 1)))


def min_max(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Scaled to 0..1 within the group; a constant column is 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(column) - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0)))


def gold_rank(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Competition rank of the labelled row: rows that score higher, plus one."""
    ranked = df.withColumn("gold_rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(score))))
    return ranked.where(F.col(label) == 1).select(key, "gold_rank")


def islands(df: DataFrame, partition: list[str], order: list[Column], label: str) -> DataFrame:
    """A group number that grows by one at each labelled row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(label).over(w))


def consecutive_first(df: DataFrame, partition: list[str], order: list[Column], column: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(column).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col(column).eqNullSafe(F.col("_before"))).drop("_before")


def masked(df: DataFrame, allowed: DataFrame, on: list[str], score: str, penalty: float = 1000.0) -> DataFrame:
    """Scores of rows that are not allowed drop by the penalty, so they lose every argmax."""
    marks = allowed.select(*on).distinct().withColumn("_in", F.lit(True))
    return df.join(marks, on, "left").withColumn(score, F.when(F.col("_in"), F.col(score)).otherwise(F.col(score) - penalty)).drop("_in")
