"""Rows of rankers are worked out once, however many folds and depths read them."""

from pyspark.sql import functions as F

from tessera.operators import boosting as bo
from tessera.operators import learning as ln


def test_folds_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: (seen.add(1), x)[1], "int").asNondeterministic()
    rows = spark.range(0, 60, 1, 2).select((F.col("id") % 20).alias("query_id"), (F.col("id") < 20).cast("int").alias("label"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("f")).withColumn("fold", mark("f")).drop("f")
    found = bo.fold_sweep(rows, ["x"], [1], [1, 2], lambda df: df.agg(F.sum("score")), bo.Settings(rounds=1, depth=1))
    assert len(found) == 2 and seen.value == 60


def test_pairs_go_both_ways(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 0, 2.0), (1, 0, 9.0), (2, 0, 1.0)], "query_id int, label int, x double")
    assert sorted(map(tuple, ln.pairwise_rows(df, ["x"]).collect())) == [(-4.0, 1.0), (-3.0, 0.0), (3.0, 1.0), (4.0, 0.0)]
