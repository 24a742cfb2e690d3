"""Plans of the token queries: a text is tokenised once, and tokens are counted without a shuffle of their own."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import tokens as tk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")


def test_one_pattern_a_row(docs):
    for df in (tk.counts(docs, ["lang", "source"], "doc_id"), tk.exploded(docs, "doc_id"), tk.index(docs, "doc_id")):
        assert len(re.findall("regexp_extract_all", plan_of(df))) == 1, plan_of(df)


def test_counts_shuffle_texts_only(docs):
    plan = plan_of(tk.counts(docs, ["lang", "source"], "doc_id"))
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan


def test_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " - "), (None, "x"), (1, "a")], "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("token", F.lit("clash"))
    got = sorted(((r.doc_id, r.token, r.n) for r in tk.counts(df, ["g"], "doc_id").collect()), key=str)
    assert got == [(1, "a", 3), (1, "b", 1), (None, "x", 1)]
    assert sorted((r.pos, r.token) for r in tk.exploded(df.where("doc_id = 1"), "doc_id").collect()) == [(0, "a"), (0, "a"), (1, "b"), (2, "a")]
    assert tk.exploded(df.where("doc_id in (2, 3, 4)"), "doc_id").count() == 0


def test_index_shuffles_texts_only(docs):
    plan = plan_of(tk.index(docs, "doc_id"))
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan


def test_index_of_repeated_and_empty_documents(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " - "), (None, "x"), (1, "b a"), (5, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.token, r.positions) for r in tk.index(df, "doc_id").collect()), key=str)
    assert got == sorted([(1, "a", [0, 1, 2]), (1, "b", [0, 1]), (5, "z", [0]), (None, "x", [0])], key=str)


def test_meaningful_tokens_stay_with_their_document(spark):
    df = tk.dealt(spark.createDataFrame([(1, "the a of b c the d of"), (2, "the x of"), (3, "the c")], "doc_id long, text string"), "doc_id")
    rows = tk.exploded(df, "doc_id")
    stops = spark.createDataFrame([("the",), ("of",), ("the",)], "token string")
    ents = tk.dealt(spark.createDataFrame([(1, 2, 4, "of b"), (1, 4, 6, "c the"), (2, 0, 2, "the x"), (3, 1, 1, "none")], "doc_id long, start int, end int, entity string"), "doc_id")
    got = {f.__name__: sorted((r.doc_id, r.pos, r.token) for r in f(rows, stops, ents).collect()) for f in (tk.meaningful, tk.spliced)}
    head = [(1, 1, "a"), (1, 2, "of b"), (1, 4, "c the"), (1, 6, "d"), (2, 0, "the x"), (3, 1, "c")]
    assert got == {"meaningful": head, "spliced": sorted([*head, (1, 7, "of"), (2, 2, "of")])}
    whole = tk.spliced(rows, stops, ents).groupBy("doc_id").count()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(whole))
    assert len([x for x in dealt if x.startswith("doc_id#")]) > 1 and not [x for x in dealt if "pos#" in x], plan_of(whole)
