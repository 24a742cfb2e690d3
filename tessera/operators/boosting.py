"""A boosted ranker with second-order trees, grown as DataFrame aggregations.

A round works out the gradient and the Hessian of the pairwise logistic loss for each candidate and
grows one tree level by level: one aggregation with partial sums gives the histogram of a level
(node, feature, bin), windows over its bins give the gain of every split, and the best split of each
node, at most two to the depth of them, comes to the driver.  Rows meet the splits in a broadcast join.

Gradients and Hessians are whole multiples of 1 / UNIT, so sums do not depend on the order in which
tasks end: trees are the same on any cluster, and after a lost executor.

Bin edges come from a sketch that merges: values are counted in buckets whose bounds grow by GROWTH,
and a bucket is an edge where the count passes another share of the rows.  Nulls, NaN and infinite
values are missing; each split sends them to the side with the higher gain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.workspace import drop, stored

#: Gradients and Hessians are counted in parts of this size.
UNIT = 1 << 20
#: Buckets of the sketch: each bound is so many times the last; SPAN is above the number of any bucket of doubles.
GROWTH, SPAN = 1.005, 200_000
MISSING = -1


def gain_sql(lam: float) -> str:
    """The gain of a split of g, h into lg, lh and the rest, as both Spark and DuckDB read it."""
    part = lambda g, h: f"power(CAST({g} AS DOUBLE) / {UNIT}, 2) / (CAST({h} AS DOUBLE) / {UNIT} + CAST({lam} AS DOUBLE))"
    return f"{part('lg', 'lh')} + {part('(g - lg)', '(h - lh)')} - {part('g', 'h')}"


@dataclass(frozen=True)
class Settings:
    """What a ranker is trained with; the defaults of eta and min_child_weight are those of the studied system."""

    rounds: int = 10
    depth: int = 4
    rate: float = 0.01
    bins: int = 32
    min_child_weight: float = 0.01
    lam: float = 1.0


@dataclass(frozen=True)
class Node:
    """A node of a tree; ``feature`` is -1 at a leaf, children of n are 2n + 1 (at most ``at``) and 2n + 2."""

    tree: int
    node: int
    feature: int
    bin: int
    at: float | None
    missing_low: bool
    gain: float
    cover: float
    value: float


NODES = "tree int, node int, feature int, bin int, at double, missing_low boolean, gain double, cover double, value double"


def present(x: Column) -> Column:
    """``x`` as a double, null where it is missing."""
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def bucket(x: Column) -> Column:
    """The number of the bucket of a value, in the order of values."""
    k = F.floor(F.log(F.abs(x)) / F.log(F.lit(GROWTH)))
    return F.when(x > 0, SPAN + k).when(x < 0, -(SPAN + k)).otherwise(F.lit(0)).cast("long")


def upper(k: int) -> float:
    """The upper bound of a bucket."""
    return 0.0 if k == 0 else GROWTH ** (k - SPAN + 1) if k > 0 else -(GROWTH ** (-k - SPAN))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(feature, bucket): the buckets after which another ``bins``-th of a feature's values is counted."""
    values = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), present(F.col(f)).alias("x")) for k, f in enumerate(features)))).alias("v"))
    sketch = values.where("v.x is not null").groupBy("v.feature", bucket(F.col("v.x")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature").orderBy("bucket")
    seen = sketch.select("feature", "bucket", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("feature")).alias("total"), "n")
    passed = F.expr(f"upto * {bins} div total > (upto - n) * {bins} div total and upto < total")
    return seen.where(passed).select("feature", "bucket")


def edges_of(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most ``bins`` edges a feature, ascending."""
    out: list[list[float]] = [[] for _ in features]
    for r in bin_edges(df, features, bins).collect():
        out[r.feature].append(upper(r.bucket))
    return [sorted(set(e)) for e in out]


def binned(x: Column, edges: list[float]) -> Column:
    """How many edges lie below a value; MISSING for a missing one."""
    value = present(x)
    below = F.size(F.filter(F.array(*(F.lit(e) for e in edges)).cast("array<double>"), lambda e: e < value))
    return F.when(value.isNull(), F.lit(MISSING)).otherwise(below).cast("int")


def derivatives(df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``g`` and ``h``: each query's candidates against its gold row, in parts of 1 / UNIT.

    The gold row that scores highest stands for its query (several at that score share the sum); other
    gold rows, and queries without a gold or another row, get 0.  Sums are made by aggregation and come
    back by a join, so a query of any size is spread over tasks.
    """
    gold = df.where("label = 1").groupBy("query_id").agg(F.max(score).alias("_gold"))
    rows = df.join(gold, "query_id", "left")
    p = 1 / (1 + F.exp(F.col("_gold") - F.col(score)))
    other = F.col("label") != 1
    rows = rows.withColumn("_g", F.when(other, F.coalesce(F.round(p * UNIT), F.lit(0.0)).cast("long"))).withColumn("_h", F.when(other, F.coalesce(F.round(p * (1 - p) * UNIT), F.lit(0.0)).cast("long")))
    stands = (F.col("label") == 1) & (F.col(score) == F.col("_gold"))
    rows = rows.withColumn("_stands", F.coalesce(stands, F.lit(False)))
    sums = rows.groupBy("query_id").agg(F.sum("_g").alias("_sg"), F.sum("_h").alias("_sh"), F.count(F.when(F.col("_stands"), 1)).alias("_share"))
    share = lambda c: F.when(F.col("_stands"), F.expr(f"{c} div _share")).otherwise(F.lit(0))
    out = rows.join(sums, "query_id", "left")
    out = out.withColumn("g", F.coalesce("_g", -share("_sg"), F.lit(0)).cast("long")).withColumn("h", F.coalesce("_h", share("_sh"), F.lit(0)).cast("long"))
    return out.drop("_gold", "_g", "_h", "_stands", "_sg", "_sh", "_share")


def histogram(rows: DataFrame) -> DataFrame:
    """(node, feature, bin, g, h) of ``rows`` with node, bins, g, h."""
    return rows.select("node", F.posexplode("bins").alias("feature", "bin"), "g", "h").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(found: DataFrame, s: Settings) -> DataFrame:
    """Of a histogram, each node's split of the highest gain above 0: ties go to the lower feature, bin, missing values high."""
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = found.select(
        "node", "feature", "bin",
        *(F.sum(F.when(F.col("bin") != MISSING, F.col(c)).otherwise(0)).over(upto).alias(f"l{c}") for c in "gh"),
        *(F.sum(F.when(F.col("bin") == MISSING, F.col(c)).otherwise(0)).over(whole).alias(f"m{c}") for c in "gh"),
        *(F.sum(c).over(whole).alias(c) for c in "gh"),
    ).where(F.col("bin") != MISSING)
    both = low.withColumn("missing_low", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({f"l{c}": F.when(F.col("missing_low"), F.col(f"l{c}") + F.col(f"m{c}")).otherwise(F.col(f"l{c}")) for c in "gh"})
    least = int(s.min_child_weight * UNIT)
    scored = both.where((F.col("lh") >= least) & (F.col("h") - F.col("lh") >= least)).withColumn("gain", F.expr(gain_sql(s.lam))).where("gain > 0")
    best = scored.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("minus"), "feature", "bin", "missing_low", "lg", "lh", "g", "h")).alias("b"))
    return best.select("node", "b.feature", "b.bin", "b.missing_low", (-F.col("b.minus")).alias("gain"), "b.lg", "b.lh", "b.g", "b.h")


def moved(rows: DataFrame, splits: list[Node]) -> DataFrame:
    """``rows`` with each row of a split node at its child."""
    table = rows.sparkSession.createDataFrame([(n.node, n.feature, n.bin, n.missing_low) for n in splits], "node int, _f int, _b int, _m boolean")
    out = rows.join(F.broadcast(table), "node", "left")
    own = F.get("bins", F.col("_f"))
    low = F.when(own == MISSING, F.col("_m")).otherwise(own <= F.col("_b"))
    return out.withColumn("node", F.when(F.col("_f").isNull(), F.col("node")).when(low, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2).cast("int")).drop("_f", "_b", "_m")


def grow(rows: DataFrame, edges: list[list[float]], s: Settings, tree: int = 0) -> tuple[list[Node], DataFrame]:
    """One tree over rows with bins, g, h, and the rows with their leaf in ``node``."""
    value = lambda g, h: -g / UNIT / (h / UNIT + s.lam)
    now, nodes = rows.withColumn("node", F.lit(0)), {}
    for level in range(s.depth):
        open_rows = now.where(F.col("node") >= 2**level - 1)
        splits = []
        for r in best_splits(histogram(open_rows), s).collect():
            at = edges[r.feature][r.bin] if r.bin < len(edges[r.feature]) else None  # above the last edge: missing values apart from all others
            splits.append(Node(tree, r.node, r.feature, r.bin, at, r.missing_low, r.gain, r.h / UNIT, value(r.g, r.h)))
            nodes[r.node] = splits[-1]
            for child, g, h in ((2 * r.node + 1, r.lg, r.lh), (2 * r.node + 2, r.g - r.lg, r.h - r.lh)):
                nodes[child] = Node(tree, child, -1, MISSING, None, False, 0.0, h / UNIT, value(g, h))
        if not splits:
            break
        now = moved(now, splits)
    if not nodes:
        g, h = rows.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0))).first()
        nodes[0] = Node(tree, 0, -1, MISSING, None, False, 0.0, h / UNIT, value(g, h))
    return [nodes[k] for k in sorted(nodes)], now


@dataclass
class Booster:
    """Trees whose leaves add up, each times ``rate``."""

    features: list[str]
    rate: float
    nodes: list[Node] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return 1 + max((n.tree for n in self.nodes), default=-1)

    def first(self, rounds: int) -> Booster:
        """The model as it stood after so many rounds."""
        return Booster(self.features, self.rate, [n for n in self.nodes if n.tree < rounds])

    def stages(self, df: DataFrame, rounds: dict[str, int]) -> DataFrame:
        """``df`` with the score after each number of rounds under its name; trees are walked over Arrow batches."""
        trees: list[dict[int, Node]] = [{} for _ in range(self.rounds)]
        for n in self.nodes:
            trees[n.tree][n.node] = n
        walks, rate, wanted = [_walkable(t) for t in trees], self.rate, sorted(rounds.values())

        @F.pandas_udf("array<double>")
        def scores(x: pd.DataFrame) -> pd.Series:
            v = x.to_numpy(np.float64)
            v[~np.isfinite(v)] = np.nan
            total, out = np.zeros(len(v)), []
            done = 0
            for n in wanted:
                for walk in walks[done:n]:
                    total = total + rate * _walked(v, walk)
                done = max(done, n)
                out.append(total)
            return pd.Series(list(np.stack(out, axis=1)) if len(v) else [], dtype=object)

        made = df.withColumn("_stages", scores(F.struct(*(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(self.features)))))
        return made.withColumns({name: F.get("_stages", F.lit(wanted.index(n))) for name, n in rounds.items()}).drop("_stages")

    def score(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """``df`` with the sum of all trees; the score may serve as a feature under any name."""
        return self.stages(df, {name: self.rounds})

    def table(self, spark: SparkSession) -> DataFrame:
        """All nodes, one row each."""
        return spark.createDataFrame([tuple(asdict(n).values()) for n in self.nodes], NODES)

    def save(self, spark: SparkSession, folder: str, name: str) -> str:
        """Write nodes and settings under ``{rounds}_{depth}_{name}``; gives the path."""
        depth = max(((n.node + 1).bit_length() - 1 for n in self.nodes), default=0)
        path = f"{folder}/{self.rounds}_{depth}_{name}"
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.features, self.rate)], "features array<string>, rate double").write.mode("overwrite").parquet(f"{path}/about")
        return path


def load_booster(spark: SparkSession, path: str) -> Booster:
    about = spark.read.parquet(f"{path}/about").first()
    rows = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect()
    return Booster(list(about.features), about.rate, [Node(*(r[f.name] for f in fields(Node))) for r in rows])


def _walkable(tree: dict[int, Node]) -> tuple[np.ndarray, ...]:
    size = max(tree) + 1
    feature, at, low, value = np.full(size, -1), np.full(size, np.inf), np.zeros(size, bool), np.zeros(size)
    for k, n in tree.items():
        feature[k], low[k], value[k] = n.feature, n.missing_low, n.value
        at[k] = np.inf if n.at is None else n.at
    return feature, at, low, value


def _walked(v: np.ndarray, walk: tuple[np.ndarray, ...]) -> np.ndarray:
    feature, at, low, value = walk
    node, rows = np.zeros(len(v), np.int64), np.arange(len(v))
    while len(open_rows := rows[feature[node] >= 0]):
        n = node[open_rows]
        x = v[open_rows, feature[n]]
        node[open_rows] = np.where(np.where(np.isnan(x), low[n], x <= at[n]), 2 * n + 1, 2 * n + 2)
    return value[node]


def train(df: DataFrame, features: list[str], s: Settings | None = None, start: Booster | None = None) -> Booster:
    """A ranker over candidates (query_id, label, features); ``start`` is trained on.

    Bins are made once; scores are written after each round and the table before goes, so neither plans
    nor lost executors make a later round start from the source, and disk holds two rounds at most.
    """
    s = s or Settings()
    model = Booster(list(features), start.rate if start else s.rate, list(start.nodes) if start else [])
    edges = edges_of(df, features, s.bins)
    scored = model.score(df, "_s") if model.nodes else df.withColumn("_s", F.lit(0.0))
    now = stored(scored.select("query_id", "label", "_s", F.array(*(binned(F.col(f), e) for f, e in zip(features, edges, strict=True))).alias("bins")))
    for r in range(model.rounds, model.rounds + s.rounds):
        rows = stored(derivatives(now, "_s"))
        drop(now)
        nodes, placed = grow(rows, edges, s, r)
        model.nodes += nodes
        values = rows.sparkSession.createDataFrame([(n.node, n.value) for n in nodes], "node int, _v double")
        after = stored(placed.join(F.broadcast(values), "node").select("query_id", "label", (F.col("_s") + model.rate * F.col("_v")).alias("_s"), "bins"))
        drop(rows)
        now = after
    drop(now)
    return model


def grouped_folds(df: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows of one key share it, by a digest of key and seed; a null key is a key."""
    digest = F.md5(F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int"))


def out_of_fold(df: DataFrame, features: list[str], s: Settings, rounds: list[int]) -> DataFrame:
    """``df`` (with ``fold``) and a score ``p_n`` after each n of ``rounds``, by the model of the other folds.

    ``df`` is stored, unless it comes from ``stored``: every fold reads it three times.
    """
    parts, df = [], df if hasattr(df, "stored_at") else stored(df)
    for k in sorted(r.fold for r in df.select("fold").distinct().collect()):
        model = train(df.where(F.col("fold") != k), features, Settings(**asdict(s) | {"rounds": max(rounds)}))
        parts.append(model.stages(df.where(F.col("fold") == k), {f"p_{n}": n for n in rounds}))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def fold_sweep(df: DataFrame, features: list[str], rounds: list[int], depths: list[int], measure: Callable[[DataFrame], DataFrame], s: Settings | None = None) -> list[tuple[int, int, float]]:
    """(rounds, depth, measure) for each point of a grid, measured on rows that no model of it was trained on.

    ``df`` has ``fold``; ``measure`` makes one number of one row from rows with ``score``.  Fewer rounds are beginnings of more, so one model serves a depth and fold.
    """
    out, kept = [], stored(df)
    for depth in depths:
        rows = stored(out_of_fold(kept, features, Settings(**asdict(s or Settings()) | {"depth": depth}), rounds))
        out += [(n, depth, measure(rows.withColumn("score", F.col(f"p_{n}"))).first()[0]) for n in rounds]
        drop(rows)
    drop(kept)
    return out


def importance(nodes: DataFrame) -> DataFrame:
    """(feature, splits, gain, cover): how often a feature splits, and the means of gain and cover over its splits."""
    return nodes.where("feature >= 0").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover"))


def split_values(nodes: DataFrame) -> DataFrame:
    """(feature, at, splits): how often each value splits a feature; null where only missing values are set apart."""
    return nodes.where("feature >= 0").groupBy("feature", "at").agg(F.count(F.lit(1)).alias("splits"))
