import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk


def test_reach():
    assert topk.reach([0.0, 2.0, 5.0], [9.0, 5.0, 4.0, 1.0]) == ([3, 3, 2, 1], [4, 3, 2])
    assert topk.reach([3.0], [2.0]) == ([0], [0])


def test_small_ranges_are_merged():
    assert topk.merged([3, 3, 5, 9, 1, 1], 8).tolist() == [0, 0, 1, 2, 3, 3]
    assert topk.merged([], 8).tolist() == []


def test_short_parts_are_not_sent_to_queries_that_need_more(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "SEEDS", 60)
    planned = topk.planned
    cells = {}

    def counted(rows, asked, n, nq):
        left, right = planned(rows, asked, n, nq)
        cells["planned"] = left.select("p", "b").distinct().count()
        cells["all"] = -(-n // 50) * -(-nq // 4)
        return left, right

    monkeypatch.setattr(topk, "planned", counted)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) * np.geomspace(1, 0.01, 900)[:, None]
    x[7] = x[8] = 0
    v = spark.createDataFrame([(k, x[k].tolist()) for k in range(900)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    y = np.floor(256 * x).astype(int)
    assert got == {q: sorted((-int(y[q] @ y[k]), k) for k in range(900) if k != q)[:5] for q in range(0, 900, 50)}
    assert 0 < cells["planned"] < cells["all"]
