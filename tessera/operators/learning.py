"""What is done with rankers: a linear one, gradients, bootstrap samples, training on mistakes and iteration.

The boosted ranker itself is in ``boosting``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import coherence as co
from tessera.operators.boosting import Booster, Settings, train
from tessera.operators.ranking import top_k
from tessera.sources.workspace import drop, shuffles_freed, stored


@dataclass
class LinearRanker:
    features: list[str]
    weights: list[float]
    scales: list[float]

    def score(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for name, weight, scale in zip(self.features, self.weights, self.scales):
            total = total + F.col(name) * F.lit(weight / scale)
        return df.withColumn("predicted", total)


def pairwise_gradients(df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``gradient``: what the pairwise logistic loss of gold against the others pulls a score by."""
    w = Window.partitionBy("query_id")
    gold = F.max(F.when(F.col("label") == 1, F.col(score))).over(w)
    pull = F.when(F.col("label") == 1, F.lit(0.0)).otherwise(1 / (1 + F.exp(gold - F.col(score))))
    rows = df.withColumn("_pull", F.coalesce(pull, F.lit(0.0)))
    return rows.withColumn("gradient", F.when(F.col("label") == 1, F.sum("_pull").over(w)).otherwise(-F.col("_pull"))).drop("_pull")


def mistakes(df: DataFrame, model: Booster) -> DataFrame:
    """Candidates of queries whose gold row does not score highest alone: what training may go on with."""
    rows = model.score(df, "_p")
    w = Window.partitionBy("query_id")
    gold = F.max(F.when(F.col("label") == 1, F.col("_p"))).over(w)
    other = F.max(F.when(F.col("label") == 0, F.col("_p"))).over(w)
    return rows.withColumn("_g", gold).withColumn("_o", other).where("_o >= _g").drop("_p", "_g", "_o")


def recurrent(df: DataFrame, edges: DataFrame, universe: int, features: list[str], iterations: int = 2, settings: Settings | None = None, k: int = 1) -> DataFrame:
    """Predict, take each mention's k best as its document's entities, work coherence out anew, train again.

    ``df``: doc_id, query_id, entity, pos, label, features.  Gives the last predictions as ``predicted``,
    with ``coherence_max`` and ``coherence_mean`` (the best and mean similarity to the predicted entities of the other mentions).
    """
    with shuffles_freed(df.sparkSession):
        columns, rows = df.columns, [stored(df)]
        now = train(rows[0], features, settings).score(rows[0])
        for _ in range(iterations):
            df, before = reduce(DataFrame.union, rows).select(columns), rows
            published = stored(top_k(now, ["query_id"], [F.desc("predicted"), F.asc("pos")], k).select("doc_id", "query_id", "entity", "rank"))
            near = stored(co.max_and_mean_of_others(df, published, edges, universe, k))
            # In turns, so that disk never holds all rows a third time, shuffled.
            rows = [stored(df.where(mine).join(near.where(mine), ["doc_id", "query_id", "entity"], "left").fillna(0.0, ["coherence_max", "coherence_mean"])) for mine in co.in_turns("query_id")]
            drop(published, near, *before)
            now = reduce(DataFrame.union, rows)
            now = train(now, [*features, "coherence_max", "coherence_mean"], settings).score(now)
        return now


def pairwise_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Differences between each query's gold row and its others, both ways round."""
    gold = df.where("label = 1").select("query_id", *(F.col(f).alias(f"g_{f}") for f in features))
    pairs = df.where("label = 0").join(gold, "query_id")
    way = lambda sign, label: F.struct(*((sign * (F.col(f"g_{f}") - F.col(f))).alias(f) for f in features), F.lit(label).alias("label"))
    return pairs.select(F.explode(F.array(way(1, 1.0), way(-1, 0.0))).alias("w")).select("w.*")


def train_pairwise(rows: DataFrame, features: list[str], iterations: int = 20) -> LinearRanker:
    spread = rows.agg(*(F.stddev(f).alias(f) for f in features)).first()
    scales = [float(spread[f] or 1.0) or 1.0 for f in features]
    scaled = rows.select(*((F.col(f) / s).alias(f) for f, s in zip(features, scales)), "label")
    model = LogisticRegression(maxIter=iterations, fitIntercept=False, standardization=False).fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    return LinearRanker(features, [float(w) for w in model.coefficients], scales)


def bootstrap(docs: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents drawn with replacement (times each, Poisson by md5 of key and seed) and those not drawn."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    times = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        times = F.when(u < POISSON[k], k).otherwise(times)
    rows = docs.select(key, times.cast("long").alias("times"))
    return rows.where("times > 0"), rows.where("times = 0").select(key)


def _poisson(n: int) -> list[float]:
    """The chances that a variable of mean 1 is at most 0, 1, ..., n - 1."""
    out, total, term = [], 0.0, 0.36787944117144233
    for k in range(n):
        total += term
        out.append(total)
        term /= k + 1
    return out


POISSON = _poisson(8)


def iterate_top_k(df: DataFrame, features: list[str], k: int, rounds: int, settings: Settings | None = None) -> DataFrame:
    """Train, keep each query's k best, and train again on what is left; ``round`` of the last filter."""
    now, before = df, None
    for r in range(rounds):
        scored = train(now, features, settings).score(now)
        kept = stored(top_k(scored, ["query_id"], [F.desc("predicted"), F.asc("pos")], k).drop("predicted", "rank").withColumn("round", F.lit(r + 1)))
        if before is not None:
            drop(before)
        now = before = kept
    return now
