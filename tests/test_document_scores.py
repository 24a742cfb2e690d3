"""Scores of all pairs of documents: as by stored pairs, and without dealing pairs anew."""

import random

from tessera.functions.similarity import UNIVERSE
from tessera.operators import coherence as co


def test_scores_as_by_stored_pairs(spark, monkeypatch):
    rng = random.Random(2)
    e = spark.createDataFrame(sorted({(rng.randrange(40), rng.randrange(30)) for _ in range(150)}), "src int, dst int")
    m = spark.createDataFrame([(rng.randrange(6), q, rng.randrange(33), rng.randrange(1, 4)) for q in range(60)], "doc_id int, query_id int, entity int, rank int")
    monkeypatch.setattr(co, "LIST", 3)
    for others, k in ((m, None), (m, 2)):
        want = co.scored_pairs(co.document_pairs(m, others, k), e, UNIVERSE)
        columns = want.columns
        want = sorted(map(tuple, want.collect()))
        monkeypatch.setattr(co, "WIDEST", 1 << 22)
        with monkeypatch.context() as only:
            only.setattr(co, "scored_pairs", None)  # pairs are not stored
            assert sorted(map(tuple, co.scored_documents(m, others, e, UNIVERSE, k).select(*columns).collect())) == want
        monkeypatch.setattr(co, "WIDEST", 1)
        assert sorted(map(tuple, co.scored_documents(m, others, e, UNIVERSE, k).select(*columns).collect())) == want
    assert co.scored_documents(m.limit(0), m, e, UNIVERSE).count() == 0


def test_pairs_stay_where_documents_are(spark):
    e = spark.createDataFrame([(s, d) for s in range(20) for d in range(3)], "src int, dst int")
    m = spark.createDataFrame([(d, q, q % 3) for d in range(9) for q in range(5)], "doc_id int, query_id int, entity int")
    out = co.two_level(co.scored_documents(m, m, e, UNIVERSE), "njs")
    dealt = [x.split(")")[0] for x in out._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert dealt and not any(x.startswith("doc_id") and "entity" in x for x in dealt)
