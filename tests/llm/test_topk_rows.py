"""Top-k by rows: repeated and missing ids, ties and odd vectors against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_and_null_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "PART_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = random.Random(seed)
    ids = [None, 0, 50, 100, *range(1, 40)] + [50] * 100  # one id holds a third of all rows
    rows = [(rng.choice(ids), [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(rng.choice([3, 4]))]) for _ in range(300)]
    rows += [(7, None), (50, [None, 1.0]), (8, [float("inf")])] + rows[:10]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "own_id", "rank", "score", "spread", "is_query")})
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.repartition(5), F.col("vec_id") % 50 == 0).collect())
    fine = [(i, [int(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and abs(x) != float("inf") for x in v)]
    want = collections.Counter()
    for k, (q, v) in enumerate(fine):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for j, (i, w) in enumerate(fine) if j != k)
            want.update((q, n, None if none else i, -s) for n, (s, none, i) in enumerate(scores[:5], 1))
    assert got == want
