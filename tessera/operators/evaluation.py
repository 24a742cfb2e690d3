"""Evaluation of ranked candidates (query_id, score, label; label 1 is gold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import min_max, top_k


def outcomes(df: DataFrame, *more: Column) -> DataFrame:
    """Each query's gold score, best other score and size; correct means gold is the only maximum.  ``more``: further aggregates."""
    gold, other = F.max(F.when(F.col("label") == 1, F.col("score"))), F.max(F.when(F.col("label") == 0, F.col("score")))
    rows = df.groupBy("query_id").agg(gold.alias("gold"), other.alias("other"), F.count("*").alias("n"), *more)
    return rows.withColumn("correct", F.coalesce((F.col("gold") > F.col("other")) | (F.col("gold").isNotNull() & F.col("other").isNull()), F.lit(False)))


def precision_recall(df: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """n, n_correct, p, r, f1; recall over the mentions in ``total``, a table of one row (all groups if not given); 0 where undefined."""
    sums = outcomes(df).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    sums = sums.crossJoin(total) if total is not None else sums.withColumn("total", F.col("n"))
    p, r = F.try_divide("n_correct", "n"), F.try_divide("n_correct", "total")
    scored = sums.select("n", "n_correct", F.coalesce(p, F.lit(0.0)).alias("p"), F.coalesce(r, F.lit(0.0)).alias("r"))
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def top_hits(df: DataFrame) -> DataFrame:
    """Top-1/2/3 hits and the mean margin of the first two, for right and wrong queries.

    A gold score tied for first counts as a top-2 hit, not as right.
    """
    gold = df.where("label = 1").groupBy("query_id").agg(F.max("score").alias("gold"))
    at = lambda j: F.max(F.when(F.col("rank") == j, F.col("score")))
    rows = top_k(df.select("query_id", "score"), ["query_id"], [F.desc("score")], 3).groupBy("query_id").agg(at(1).alias("s1"), at(2).alias("s2"), at(3).alias("s3"))
    rows = rows.join(gold, "query_id", "left").select("gold", "s1", "s2", "s3")
    right = F.coalesce((F.col("gold") == F.col("s1")) & ((F.col("s2") < F.col("s1")) | F.col("s2").isNull()), F.lit(False))
    hit2 = F.coalesce(F.col("gold") >= F.coalesce("s2", "s1"), F.lit(False))
    hit3 = F.coalesce(F.col("gold") >= F.coalesce("s3", "s2", "s1"), F.lit(False))
    margin = F.col("s1") - F.col("s2")
    return rows.agg(F.count("*").alias("n"), F.count_if(right).alias("top1"), F.count_if(hit2).alias("top2"), F.count_if(hit3).alias("top3"), F.avg(F.when(right, margin)).alias("margin_right"), F.avg(F.when(~right, margin)).alias("margin_wrong"))


def coverage(df: DataFrame) -> DataFrame:
    """Queries, those with gold among the candidates, and those with gold on top of the dictionary."""
    rows = df.groupBy("query_id").agg(F.max("label").alias("has"), F.max_by("label", F.struct(F.col("prior"), -F.col("pos"))).alias("first"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("has") == 1).alias("in_dict"), F.count_if(F.col("first") == 1).alias("top_of_dict")).withColumn("percent", F.try_divide(100.0 * F.col("in_dict"), F.col("n")))


def errors_by_document(df: DataFrame) -> DataFrame:
    """Errors and totals of each document (df has doc_id too)."""
    # A query's documents are gathered beside its outcome: its rows are sorted once and nothing is joined.
    rows = outcomes(df, F.collect_set(F.struct("doc_id")).alias("docs")).where("query_id is not null")
    return rows.select("correct", F.explode("docs").alias("d")).select("d.doc_id", "correct").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("errors"))


def margin_histogram(df: DataFrame) -> DataFrame:
    """(outcome, margin, n): rounded margins of the first two scores, -1 for queries of one row.

    Right queries count with their margin, wrong ones where the gold row is second.
    """
    top = top_k(df.select("query_id", "score"), ["query_id"], [F.desc("score")], 2)
    at = lambda j: F.max(F.when(F.col("rank") == j, F.col("score")))
    rows = top.groupBy("query_id").agg(at(1).alias("s1"), at(2).alias("s2")).join(outcomes(df), "query_id")
    counted = rows.where(F.col("correct") | (F.col("gold") == F.col("s2")) | (F.col("n") == 1))
    margin = F.when(F.col("n") == 1, -1.0).otherwise(F.rint(F.col("s1") - F.col("s2")))
    return counted.groupBy(F.when(F.col("correct"), "right").otherwise("wrong").alias("outcome"), margin.alias("margin")).agg(F.count("*").alias("n"))


def errors_by_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Each document's errors by category of the gold entity, and the wrong queries in order.

    ``df``: doc_id, query_id, entity, score, label; ``categories``: entity, category.
    """
    gold = df.where("label = 1").select("doc_id", "query_id", "entity").join(categories, "entity", "left")
    rows = gold.join(outcomes(df), "query_id")
    wrong = F.sort_array(F.collect_list(F.when(~F.col("correct"), F.col("query_id"))))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("errors"), wrong.alias("wrong"))


def evaluated(df: DataFrame, measure) -> DataFrame:
    """The outcome of a measure of the caller's choice, a function of the ranked candidates."""
    return measure(df)


def linear_blend(df: DataFrame, first: str, second: str, weight: float) -> DataFrame:
    """Accuracy of a blend of two features, each scaled within its query."""
    scaled = min_max(min_max(df, ["query_id"], first, "_a"), ["query_id"], second, "_b")
    scored = scaled.select("query_id", "label", (weight * F.col("_a") + (1 - weight) * F.col("_b")).alias("score"))
    return outcomes(scored).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).withColumn("accuracy", F.try_divide("n_correct", "n"))
