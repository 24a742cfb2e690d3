"""Links of asked pairs against plain Python; a pair costs its rarer end."""

import random

from pyspark.sql import functions as F

from tessera.operators import coherence as co


def test_links_and_their_cost(spark):
    rng = random.Random(4)
    edges = {(s, 0) for s in range(300)} | {(s, d) for s in range(300) for d in rng.sample(range(1, 40), rng.randrange(5))}
    pairs = {(rng.randrange(45), rng.randrange(45)) for _ in range(120)} | {(0, 7), (7, 0)}
    pairs = [(a, b) for a, b in pairs if a != b]
    e = spark.createDataFrame(sorted(edges), "src int, dst int").withColumn("rare", F.lit("clash"))
    p = spark.createDataFrame(pairs + pairs[:9], "entity int, other int")
    sources = {d: {s for s, x in edges if x == d} for d in range(45)}
    want = {(min(x), max(x)): (len(sources[x[0]] & sources[x[1]]), len(sources[min(x)]), len(sources[max(x)])) for x in pairs}
    assert {(r.a, r.b): (r.common, r.degree_a, r.degree_b) for r in co.pair_links(p, e).collect()} == want
    sized = co.sized_pairs(spark.createDataFrame(sorted(want), "a int, b int"), e)
    # Either way gives the same, and the one that is taken makes no more rows than rarer ends have links.
    for found in (co.common_from_rarer(sized, e), co.common_at_sources(sized, e)):
        assert {(r.a, r.b): (r.common, r.degree_a, r.degree_b) for r in found.collect()} == want
    cost = sum(min(da, db) for _, da, db in want.values())
    assert co.rarer_sources(sized, e).where("src is not null").count() == cost
    assert co.pair_links(p.limit(0), e).count() == 0
    assert {(r.common, r.degree_a, r.degree_b) for r in co.pair_links(p, e.limit(0)).collect()} == {(0, 0, 0)}


def test_the_cheaper_way_is_taken(spark, monkeypatch):
    taken = []
    for name in ("common_from_rarer", "common_at_sources"):
        monkeypatch.setattr(co, name, lambda sized, near, true=getattr(co, name), name=name: (taken.append(name), true(sized, near))[1])
    hub = spark.createDataFrame([(0, d) for d in range(60)] + [(s, 60) for s in range(1, 30)], "src int, dst int")
    asked = spark.createDataFrame([(d, d + 1) for d in range(0, 60, 2)], "entity int, other int")
    assert {(r.common, r.degree_a) for r in co.pair_links(asked, hub).collect()} == {(1, 1)}
    many = spark.createDataFrame([(s, d) for s in range(40) for d in (0, 1)] + [(99, 2)], "src int, dst int")
    every = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "entity int, other int")
    assert {(r.a, r.b): r.common for r in co.pair_links(every, many).collect()} == {(0, 1): 40, (0, 2): 0, (1, 2): 0}
    assert taken == ["common_from_rarer", "common_at_sources"]
