"""Ranking models and iteration, with every round and level of a boosted model spelled out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.similarity import UNIVERSE
from tessera.operators import boosting as bo
from tessera.operators import evaluation as ev
from tessera.operators import learning as ln
from tessera.plans import boosted_sql as bs
from tessera.plans.registry import query
from tessera.plans.views import CANDIDATES, EDGES, candidates, edges
from tessera.sources.readers import parquet
from tessera.sources.workspace import fresh_path, stored

FEATURES = ["prior", "score"]
TIMES = "CASE " + " ".join(f"WHEN u < {x!r} THEN {k}" for k, x in enumerate(ln.POISSON)) + f" ELSE {len(ln.POISSON)} END"


@query(f"""SELECT doc_id, times::BIGINT AS times, CASE WHEN times > 0 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, {TIMES} AS times
    FROM (SELECT doc_id, ('0x' || substr(md5(doc_id || '-1'), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders)))""")
def bootstrap_oob(spark, d):
    drawn, left = ln.bootstrap(parquet(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")).distinct(), "doc_id", 1)
    return drawn.withColumn("part", F.lit("train")).unionByName(left.withColumn("times", F.lit(0).cast("long")).withColumn("part", F.lit("test")))


@query(f"""SELECT query_id, pos, round(CASE WHEN label = 1 THEN sum(pull) OVER w ELSE -pull END, 6) + 0.0 AS gradient
    FROM (SELECT *, CASE WHEN label = 1 THEN 0 ELSE 1 / (1 + exp(max(CASE WHEN label = 1 THEN score / 1000 END) OVER (PARTITION BY query_id) - score / 1000)) END AS pull FROM {CANDIDATES}) WINDOW w AS (PARTITION BY query_id)""")
def pairwise_gradients(spark, d):
    rows = candidates(spark, d).withColumn("s", F.col("score") / 1000)
    return ln.pairwise_gradients(rows, "s").select("query_id", "pos", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query()
def pairwise_ranker(spark, d):
    rows = stored(candidates(spark, d).select("query_id", "pos", "label", *FEATURES))
    model = ln.train_pairwise(ln.pairwise_rows(rows, FEATURES), FEATURES)
    return model.score(rows).select("query_id", "pos", F.round("predicted", 6).alias("predicted"))


TAUGHT = f"(SELECT *, TRUE AS taught FROM {CANDIDATES})"


def _with(tables: list[str]) -> str:
    return "WITH " + ", ".join(tables)


@query(f"SELECT query_id, pos, g::BIGINT AS g, h::BIGINT AS h FROM {bs.derivatives_sql(f'(SELECT *, score / 1000 AS s FROM {CANDIDATES})')}")
def ranker_derivatives(spark, d):
    """Gradients and Hessians of a round, in whole parts."""
    return bo.derivatives(candidates(spark, d).withColumn("s", F.col("score") / 1000), "s").select("query_id", "pos", "g", "h")


@query(f"WITH {bs.edges_sql('e', CANDIDATES, FEATURES, 32)} SELECT feature, bucket FROM e")
def ranker_bin_edges(spark, d):
    return bo.bin_edges(candidates(spark, d), FEATURES, 32)


FIRST = bo.Settings(rounds=1, depth=3)


@query(f"{_with(bs.model_sql('m', TAUGHT, FEATURES, FIRST))} SELECT node, feature, bin::INTEGER AS bin, missing_low, round(gain, 6) AS gain, h::DOUBLE / {bo.UNIT} AS cover FROM m_t0")
def ranker_first_splits(spark, d):
    """What the first round chooses: each node's feature, bin and gain."""
    return bo.train(candidates(spark, d), FEATURES, FIRST).table(spark).where("feature >= 0").select("node", "feature", "bin", "missing_low", F.round("gain", 6).alias("gain"), "cover")


SMALL = bo.Settings(rounds=3, depth=3, rate=0.3)


@query(f"{_with(bs.model_sql('m', TAUGHT, FEATURES, SMALL))} SELECT query_id, pos, round(s, 6) + 0.0 AS boosted FROM m_s3")
def boosted_ranker(spark, d):
    """Trained, saved, read again, and its score taken as a feature."""
    rows = stored(candidates(spark, d).select("query_id", "pos", "label", *FEATURES))
    path = bo.train(rows, FEATURES, SMALL).save(spark, fresh_path(spark), "base")
    return bo.load_booster(spark, path).score(rows, "boosted").select("query_id", "pos", (F.round("boosted", 6) + 0.0).alias("boosted"))


TREES = f"({' UNION ALL '.join(f'SELECT * FROM m_t{r}' for r in range(3))})"


@query(f"{_with(bs.model_sql('m', TAUGHT, FEATURES, SMALL))} SELECT feature, count(*) AS splits, round(avg(gain), 6) AS gain, round(avg(h::DOUBLE / {bo.UNIT}), 4) AS cover FROM {TREES} GROUP BY feature")
def ranker_importance(spark, d):
    """Splits, mean gain and mean cover of each feature."""
    nodes = bo.train(candidates(spark, d), FEATURES, SMALL).table(spark)
    return bo.importance(nodes).select("feature", "splits", F.round("gain", 6).alias("gain"), F.round("cover", 4).alias("cover"))


@query(f"""{_with(bs.model_sql('m', TAUGHT, FEATURES, SMALL))}, e AS (SELECT feature, at_most, row_number() OVER (PARTITION BY feature ORDER BY at_most) - 1 AS bin FROM m_e)
    SELECT feature, round(at_most, 4) AS at, count(*) AS splits FROM {TREES} LEFT JOIN e USING (feature, bin) GROUP BY ALL""")
def ranker_split_values(spark, d):
    """How often each value splits a feature, from the saved trees."""
    path = bo.train(candidates(spark, d), FEATURES, SMALL).save(spark, fresh_path(spark), "split")
    return bo.split_values(spark.read.schema(bo.NODES).parquet(f"{path}/nodes")).select("feature", F.round("at", 4).alias("at"), "splits")


FOLD = "(('0x' || substr(md5(o_custkey || '-0'), 1, 8))::BIGINT % {n})::INTEGER"


def _folded(n: int) -> str:
    return f"(SELECT c.*, {FOLD.format(n=n)} AS fold FROM {CANDIDATES} c JOIN orders ON query_id = o_orderkey)"


def _in_folds(spark, d, n):
    own = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    return bo.grouped_folds(candidates(spark, d).join(own, "query_id"), "doc_id", n)


@query(f"SELECT fold, count(*) AS n, count(DISTINCT query_id) AS queries, sum(label)::BIGINT AS gold FROM {_folded(5)} GROUP BY fold")
def ranker_folds(spark, d):
    """Rows, queries and gold rows of five folds by document."""
    return _in_folds(spark, d, 5).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.sum("label").alias("gold"))


HALVES = bo.Settings(rounds=2, depth=2, rate=0.3)


def _halves(depth: int) -> list[str]:
    s = bo.Settings(rounds=2, depth=depth, rate=0.3)
    return [t for k in (0, 1) for t in bs.model_sql(f"d{depth}f{k}", f"(SELECT *, fold <> {k} AS taught FROM {_folded(2)})", FEATURES, s)]


def _unseen(depth: int, rounds: int) -> str:
    return " UNION ALL ".join(f"SELECT query_id, pos, label, s FROM d{depth}f{k}_s{rounds} WHERE NOT taught" for k in (0, 1))


@query(f"{_with(_halves(2))} SELECT a.query_id, a.pos, round(a.s, 6) + 0.0 AS p_1, round(b.s, 6) + 0.0 AS p_2 FROM ({_unseen(2, 1)}) a JOIN ({_unseen(2, 2)}) b USING (query_id, pos)")
def ranker_out_of_fold(spark, d):
    """Each row's score by the model of the other fold, after one and two rounds."""
    out = bo.out_of_fold(_in_folds(spark, d, 2), FEATURES, HALVES, [1, 2])
    return out.select("query_id", "pos", *((F.round(c, 6) + 0.0).alias(c) for c in ("p_1", "p_2")))


def _precision(depth: int, rounds: int) -> str:
    return f"""SELECT {rounds} AS rounds, {depth} AS depth, round(avg((coalesce(gold > other, gold IS NOT NULL))::INTEGER), 6) AS p FROM (
        SELECT query_id, max(CASE WHEN label = 1 THEN s END) AS gold, max(CASE WHEN label = 0 THEN s END) AS other FROM ({_unseen(depth, rounds)}) GROUP BY query_id)"""


@query(f"{_with(_halves(2) + _halves(3))} {' UNION ALL '.join(_precision(depth, n) for depth in (2, 3) for n in (1, 2))}")
def ranker_sweep(spark, d):
    """Precision of a grid of rounds and depths, each row scored by the model of the other fold."""
    found = bo.fold_sweep(_in_folds(spark, d, 2), FEATURES, [1, 2], [2, 3], lambda df: ev.precision_recall(df).select("p"), HALVES)
    return spark.createDataFrame([(n, depth, round(float(p), 6)) for n, depth, p in found], "rounds int, depth int, p double")


ONCE = bo.Settings(rounds=2, depth=3, rate=0.3)
MORE = bo.Settings(rounds=1, depth=3, rate=0.3)
WRONG = "(SELECT c.*, NOT coalesce(gold > other, gold IS NOT NULL) AND gold IS NOT NULL AS taught FROM {rows} c JOIN (SELECT query_id, max(CASE WHEN label = 1 THEN s END) AS gold, max(CASE WHEN label = 0 THEN s END) AS other FROM m_s2 GROUP BY query_id) USING (query_id))"


@query(f"{_with(bs.model_sql('m', TAUGHT, FEATURES, ONCE) + bs.model_sql('w', WRONG.format(rows=CANDIDATES), FEATURES, MORE, start='m_s2', first=2))} SELECT query_id, pos, round(s, 6) + 0.0 AS predicted FROM w_s3")
def ranker_on_mistakes(spark, d):
    """Trained on, by the queries whose gold row does not score highest alone."""
    rows = stored(candidates(spark, d).select("query_id", "pos", "label", *FEATURES))
    first = bo.train(rows, FEATURES, ONCE)
    more = bo.train(ln.mistakes(rows, first), FEATURES, MORE, start=first)
    return more.score(rows).select("query_id", "pos", (F.round("predicted", 6) + 0.0).alias("predicted"))


OWNED = f"(SELECT o_custkey AS doc_id, c.* FROM {CANDIDATES} c JOIN orders ON query_id = o_orderkey)"
NEAR = f"""near AS MATERIALIZED (SELECT doc_id, query_id, entity, max(hi) AS coherence_max, avg(hi) AS coherence_mean FROM (
        SELECT doc_id, query_id, entity, other_query, max(ln(coalesce(common, 0) + 1) / ln(da + db - coalesce(common, 0) + 1)) AS hi FROM pairs
        LEFT JOIN (SELECT x.dst AS entity, y.dst AS other, count(*) AS common FROM {EDGES} x JOIN {EDGES} y ON x.src = y.src AND x.dst <> y.dst GROUP BY ALL) USING (entity, other)
        JOIN (SELECT dst AS entity, count(*) AS da FROM {EDGES} GROUP BY ALL) USING (entity) JOIN (SELECT dst AS other, count(*) AS db FROM {EDGES} GROUP BY ALL) USING (other)
        GROUP BY ALL) GROUP BY ALL)"""
COHERENT = [*FEATURES, "coherence_max", "coherence_mean"]
RECURRENT = [
    f"owned AS MATERIALIZED (SELECT *, TRUE AS taught FROM {OWNED})",
    *bs.model_sql("m", "owned", FEATURES, HALVES),
    "best AS MATERIALIZED (SELECT o.doc_id, o.query_id, o.entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS k FROM m_s2) m JOIN owned o USING (query_id, pos) WHERE k = 1)",
    "pairs AS MATERIALIZED (SELECT o.doc_id, o.query_id, o.entity, b.query_id AS other_query, b.entity AS other FROM owned o JOIN best b ON o.doc_id = b.doc_id AND o.query_id <> b.query_id AND o.entity <> b.entity)",
    NEAR,
    "again AS MATERIALIZED (SELECT o.*, coalesce(coherence_max, 0) AS coherence_max, coalesce(coherence_mean, 0) AS coherence_mean FROM owned o LEFT JOIN near USING (doc_id, query_id, entity))",
    *bs.model_sql("c", "again", COHERENT, HALVES),
]


@query(f"{_with(RECURRENT)} SELECT query_id, pos, round(coherence_max, 6) AS coherence_max, round(s, 6) + 0.0 AS predicted FROM c_s2 JOIN again USING (query_id, pos)")
def recurrent_linking(spark, d):
    own = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    rows = candidates(spark, d).join(own, "query_id").select("doc_id", "query_id", "entity", "pos", "label", *FEATURES)
    out = ln.recurrent(rows, edges(spark, d), UNIVERSE, FEATURES, iterations=1, settings=HALVES)
    return out.select("query_id", "pos", F.round("coherence_max", 6).alias("coherence_max"), (F.round("predicted", 6) + 0.0).alias("predicted"))


FILTERED = [
    f"all_rows AS MATERIALIZED (SELECT *, TRUE AS taught FROM {CANDIDATES})",
    *bs.model_sql("m", "all_rows", FEATURES, HALVES),
    "kept AS MATERIALIZED (SELECT a.* FROM all_rows a JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS k FROM m_s2) USING (query_id, pos) WHERE k <= 3)",
    *bs.model_sql("n", "kept", FEATURES, HALVES),
]


@query(f"{_with(FILTERED)} SELECT query_id, entity, pos, 2 AS round FROM kept JOIN (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS k FROM n_s2) USING (query_id, pos) WHERE k <= 2")
def iterate_topk_filter(spark, d):
    """The three best of a first model, the two best of a model trained on them."""
    first = ln.iterate_top_k(candidates(spark, d), FEATURES, 3, 1, HALVES)
    return ln.iterate_top_k(first, FEATURES, 2, 1, HALVES).select("query_id", "entity", "pos", F.lit(2).alias("round"))
