"""Coherence of a training round: as over all pairs, in turns, and without leaving what it shuffled on the disks."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions.similarity import UNIVERSE
from tessera.operators import coherence as co
from tessera.operators import learning as ln
from tessera.operators.boosting import Settings
from tessera.sources.workspace import stored


def tables(spark, seed):
    rng = random.Random(seed)
    e = spark.createDataFrame(sorted({(rng.randrange(40), rng.randrange(30)) for _ in range(150)}), "src int, dst int")
    rows = [(rng.choice([None, *range(6)]), q, pos, rng.choice([None, *range(9), *range(33)]), rng.random(), int(pos == 1)) for q in range(60) for pos in range(1, 5)]
    rows += [(7, q, 1, 3, 0.5, 1) for q in (100, 101, 102)] + [(8, 103, pos, pos, 0.5, 1) for pos in (1, 2)]  # mentions of one entity, a mention alone
    return e, spark.createDataFrame(rows, "doc_id int, query_id int, pos int, entity int, prior double, label int")


def test_max_and_mean_as_over_all_pairs(spark, monkeypatch):
    for seed, k, least in ((1, 1, 1 << 10), (2, 2, 1 << 10), (3, 1, 1 << 20)):
        e, m = tables(spark, seed)
        m = m.union(m.limit(20)).union(spark.createDataFrame([(1, None, 1, 2, 0.1, 0), (2, 200, 9, 4, 0.1, 0)], m.schema))
        published = m.withColumn("rank", F.col("pos")).where((F.col("pos") < 4) & (F.coalesce("query_id", F.lit(0)) % 7 != 0))
        with monkeypatch.context() as small:
            small.setattr(co, "LIST", 3)
            small.setattr(co, "PAIRS_A_PART", least)
            got = co.max_and_mean_of_others(m, published, e, UNIVERSE, k).collect()
        want = co.two_level(co.scored_pairs(co.document_pairs(m, published, k), e, UNIVERSE), "njs").where("max_max > 0").collect()
        assert len(want) > 20 and len({r[:3] for r in got}) == len(got)
        assert {tuple(r[:3]): (round(r.coherence_max, 12), round(r.coherence_mean, 12)) for r in got} == {tuple(r[:3]): (round(r.max_max, 12), round(r.avg_max, 12)) for r in want}
        monkeypatch.setattr(co, "WIDEST", 1)  # by stored pairs
        again = co.max_and_mean_of_others(m, published, e, UNIVERSE, k).where("coherence_max > 0").collect()
        assert sorted((*r[:3], round(r[3], 12), round(r[4], 12)) for r in again) == sorted((*r[:3], round(r[3], 12), round(r[4], 12)) for r in got)
        monkeypatch.setattr(co, "WIDEST", 1 << 22)


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_shuffled_rows_go_with_their_job(spark):
    e, m = tables(spark, 5)
    m = stored(m.dropna())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(key), shuffled(spark)
    out = ln.recurrent(m, e, UNIVERSE, ["prior"], iterations=1, settings=Settings(rounds=1, depth=1, rate=0.3))
    for _ in range(50):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == set_before
    assert out.count() == m.count() and {"predicted", "coherence_max", "coherence_mean"} <= set(out.columns)
