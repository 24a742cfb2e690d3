"""The boosted ranker against plain Python, and odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as bo
from tessera.operators import evaluation as ev
from tessera.operators import learning as ln

U = bo.UNIT


def made(seed, n=60):
    rng, rows = random.Random(seed), []
    for q in range(n):
        size = rng.randrange(1, 6) if q else 120  # one query holds a third of all rows
        gold = rng.randrange(size)
        for p in range(size):
            x = rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 3) + (p == gold), -2.0, 0.0])
            label = int(p == gold) if q % 9 else 0 if q % 2 else int(p <= 1)
            rows.append((q, p, label, x, float(rng.randrange(4)), rng.choice([None, 1.5])))
    return rows


FEATURES = ["x", "y", "z"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id long, pos int, label int, x double, y double, z double").withColumns({"node": F.lit("clash"), "g": F.lit(1), "feature": F.lit(2)})


def plain_derivatives(rows, s):
    out = {}
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        golds = [s[q, r[1]] for r in own if r[2] == 1]
        if not golds:
            out |= {(q, r[1]): (0, 0) for r in own}
            continue
        best, sg, sh = max(golds), 0, 0
        for r in own:
            if r[2] != 1:
                p = 1 / (1 + math.exp(best - s[q, r[1]]))
                out[q, r[1]] = (math.floor(p * U + 0.5), math.floor(p * (1 - p) * U + 0.5))
                sg, sh = sg + out[q, r[1]][0], sh + out[q, r[1]][1]
        stands = [r[1] for r in own if r[2] == 1 and s[q, r[1]] == best]
        for r in own:
            if r[2] == 1:
                out[q, r[1]] = (-(sg // len(stands)), sh // len(stands)) if r[1] in stands else (0, 0)
    return out


def plain_tree(rows, gh, edges, depth, s):
    """{node: (feature, bin, missing_low)} and each row's leaf, by trying every split."""
    fine = lambda x: x is not None and math.isfinite(x)
    bins = {(r[0], r[1]): [sum(e < x for e in es) if fine(x) else -1 for x, es in zip(r[3:], edges)] for r in rows}
    at, splits = {k: 0 for k in bins}, {}
    score = lambda g, h: (g / U) ** 2 / (h / U + s.lam)
    for level in range(depth):
        for node in sorted({n for n in at.values() if n >= 2**level - 1}):
            own = [k for k in at if at[k] == node]
            g, h = (sum(gh[k][j] for k in own) for j in (0, 1))
            tried = []
            for f in range(len(edges)):
                for b in sorted({bins[k][f] for k in own} - {-1}):
                    for m in (False, True):
                        low = [k for k in own if (m if bins[k][f] == -1 else bins[k][f] <= b)]
                        lg, lh = (sum(gh[k][j] for k in low) for j in (0, 1))
                        if lh >= int(s.min_child_weight * U) and h - lh >= int(s.min_child_weight * U):
                            gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                            if gain > 0:
                                tried.append((-gain, f, b, m))
            if tried:
                _, f, b, m = min(tried)
                splits[node] = (f, b, m)
                for k in own:
                    at[k] = 2 * node + (1 if (m if bins[k][f] == -1 else bins[k][f] <= b) else 2)
    return splits, at


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_against_plain_python(spark, seed):
    rows, s = made(seed), bo.Settings(rounds=2, depth=3, rate=0.5, bins=8)
    df = frame(spark, rows)
    edges = bo.edges_of(df, FEATURES, s.bins)
    assert all(len(e) < s.bins for e in edges) and edges[1] and edges == [sorted(e) for e in edges]
    model = bo.train(df, FEATURES, s)
    scores = {(r[0], r[1]): 0.0 for r in rows}
    for r in range(s.rounds):
        gh = plain_derivatives(rows, scores)
        if r == 0:
            got = {(x.query_id, x.pos): (x.g, x.h) for x in bo.derivatives(df.drop("g").withColumn("s", F.lit(0.0)), "s").collect()}
            assert got == gh
        splits, at = plain_tree(rows, gh, edges, s.depth, s)
        assert {n.node: (n.feature, n.bin, n.missing_low) for n in model.nodes if n.tree == r and n.feature >= 0} == splits and splits
        for leaf in set(at.values()):
            own = [k for k in at if at[k] == leaf]
            value = -sum(gh[k][0] for k in own) / U / (sum(gh[k][1] for k in own) / U + s.lam)
            for k in own:
                scores[k] += s.rate * value
    got = {(x.query_id, x.pos): x.predicted for x in model.score(df).collect()}
    assert got == pytest.approx(scores, abs=1e-12)


def test_sketch_edges_split_values_evenly(spark):
    df = spark.range(10000).select((F.col("id") * 1.0 - 3000).alias("x"))
    edges = bo.edges_of(df, ["x"], 10)[0]
    shares = [sum(1 for i in range(10000) if lo < i - 3000 <= hi) for lo, hi in zip([-1e9, *edges], [*edges, 1e9])]
    assert len(edges) == 9 and all(900 < n < 1100 for n in shares)
    for v in (1.0, 0.5, 7.25, 1e300, 1e-300, -1.0, -3.5, -1e-300, 0.0):
        k = df.limit(1).select(bo.bucket(F.lit(v)).alias("k")).first().k
        assert v <= bo.upper(k) * (1 + 1e-9) if v > 0 else v <= bo.upper(k) * (1 - 1e-9) if v < 0 else bo.upper(k) == 0


def test_save_load_and_training_on(spark, tmp_path):
    df = spark.createDataFrame([(q, int(p == 0), float(p == 0) + q * 0.001, float(p)) for q in range(40) for p in range(4)], "query_id long, label int, x double, y double")
    s = bo.Settings(rounds=2, depth=2, rate=0.3)
    model = bo.train(df, ["x", "y"], s)
    path = model.save(spark, f"file://{tmp_path}", "m")
    again = bo.load_booster(spark, path)
    assert path.endswith("/2_1_m") and again == model and again.rounds == 2
    whole = bo.train(df, ["x", "y"], bo.Settings(rounds=3, depth=2, rate=0.3))
    more = bo.train(df, ["x", "y"], bo.Settings(rounds=1, depth=2, rate=0.3), start=again)
    assert whole.first(2) == model and more.rounds == 3 and [(n.node, n.feature) for n in more.nodes] == [(n.node, n.feature) for n in whole.nodes]
    stages = whole.stages(df, {"a": 2, "b": 3}).collect()
    assert [r.a for r in stages] == [r.predicted for r in model.score(df).collect()] and [r.b for r in stages] == [r.predicted for r in whole.score(df).collect()]
    right = ev.precision_recall(again.score(df, "score")).first()
    assert right.n_correct == 40 and ln.mistakes(df, model).count() == 0
    table = spark.read.schema(bo.NODES).parquet(f"{path}/nodes")
    assert bo.importance(table).agg(F.sum("splits")).first()[0] == bo.split_values(table).agg(F.sum("splits")).first()[0] == sum(n.feature >= 0 for n in model.nodes)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], "query_id long, label int, x double")
    model = bo.train(df, ["x"], bo.Settings(rounds=1, depth=2))
    assert [(n.node, n.value) for n in model.nodes] == [(0, 0.0)] and model.score(df).count() == 0
    flat = spark.createDataFrame([(1, 1, None), (1, 0, None), (None, 0, 1.0)], "query_id long, label int, x double")
    model = bo.train(flat, ["x"], bo.Settings(rounds=1, depth=2))
    assert {r.predicted for r in model.score(flat).collect()} == {0.0}


def test_folds_keep_documents_whole(spark):
    rows = [(q, p, int(p == q % 3), float(p == q % 3) + 0.1 * q, f"doc{q // 4}" if q % 11 else None) for q in range(80) for p in range(3)]
    df = bo.grouped_folds(spark.createDataFrame(rows, "query_id long, pos int, label int, x double, doc string"), "doc", 3)
    per = df.groupBy(F.coalesce("doc", F.lit("none"))).agg(F.count_distinct("fold").alias("n")).collect()
    assert {r.n for r in per} == {1} and {r.fold for r in df.select("fold").distinct().collect()} == {0, 1, 2}
    s = bo.Settings(rounds=2, depth=2, rate=0.3)
    out = bo.out_of_fold(df, ["x"], s, [1, 2])
    assert out.count() == len(rows)
    for k in range(3):
        other = bo.train(df.where(F.col("fold") != k), ["x"], s)
        want = {(r.query_id, r.pos): r.predicted for r in other.score(df.where(F.col("fold") == k)).collect()}
        assert {(r.query_id, r.pos): r.p_2 for r in out.where(F.col("fold") == k).collect()} == want
    grid = bo.fold_sweep(df, ["x"], [1, 2], [1, 2], lambda d: ev.precision_recall(d).select("p"), s)
    assert [(n, d) for n, d, _ in grid] == [(1, 1), (2, 1), (1, 2), (2, 2)]
