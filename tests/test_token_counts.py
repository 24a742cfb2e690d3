"""Counts of tokens: repeated documents count together, tasks have no table of all their tokens."""

from collections import Counter

from tessera.operators import tokens as tk


def test_counts_by_document(spark, monkeypatch):
    monkeypatch.setattr(tk, "DOCS_A_PART", 2)
    docs = [("e", 1, "b a B"), ("e", 1, "a c"), ("e", 2, None), ("e", 3, "  "), ("f", 1, "a"), ("e", None, "x x"), ("e", None, "x")]
    got = tk.counts(spark.createDataFrame(docs, "lang string, doc_id int, text string"), ["lang"], "doc_id")
    words = {}
    for lang, doc, text in docs:
        words.setdefault((lang, doc), Counter()).update((text or "").lower().split())
    want = {(lang, doc, t, n, sum(c.values())) for (lang, doc), c in words.items() for t, n in c.items()}
    rows = [tuple(r) for r in got.select("lang", "doc_id", "token", "n", "total").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "token" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate(keys" in x)
