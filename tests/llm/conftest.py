import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long_text = "alpha beta gamma delta epsilon " * 4000
    rows = [(1, None), (2, ""), (3, "   "), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, long_text), (7, long_text + "x"), (None, "no id here at all"), (8, "é ß 漢字 'tis they'll\n\n  end ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(1 as bigint) as n_chars", "1 as id", "2 as value", "3 as n", "'b' as bucket", "4 as shard")
