"""Tables dealt out in parts of bounded size: the same results, and tasks that do not grow with the table."""

from pyspark.sql import functions as F

from tessera.operators import coherence as co
from tessera.operators import evaluation as ev
from tessera.sources import readers


def test_large_tables_are_dealt_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_A_PART", 10)
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    assert readers.dealt_rows(df, 100, "k").rdd.getNumPartitions() == 10
    assert readers.dealt_rows(df, 15, "k").rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_errors_of_queries_in_many_documents(spark):
    rows = [(1, 1, 3.0, 1), (1, 1, 2.0, 0), (2, 1, 3.0, 1), (1, 2, 1.0, 1), (1, 2, 1.0, 0), (None, 3, 1.0, 0), (4, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id int, query_id int, score double, label int")
    found = ev.errors_by_document(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([(1, 2, 1), (2, 1, 0), (None, 1, 1)], key=str)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_phrases_meet_where_they_lie(spark, monkeypatch):
    rows = [(d, p, t, t % 3, float(p + t)) for d in range(6) for p in range(4) for t in range(p, p + 3)]
    df = spark.createDataFrame(rows, "doc int, phrase int, token int, pos int, weight double")
    want = sorted(tuple(r) for r in co.phrase_similarity(df, df, ["doc"]).collect())
    monkeypatch.setattr(co, "PHRASE_ROWS_A_PART", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = co.phrase_similarity(df, df, ["doc"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc#") == plan.count("Exchange hashpartitioning(") == 3, plan
        assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
