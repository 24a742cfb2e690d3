"""Exact top-k inner products over integer vectors.

Vectors are processed by descending length.  Coordinates are rotated onto the singular vectors of
all rows, so the first HEAD hold most of each product; the rest is bounded by Cauchy-Schwarz.
A pair is worked out in full only if head plus bound can reach the query's threshold, the k-th best
score met so far; thresholds start from the longest SEEDS vectors.

Candidates are dealt into parts by descending length, queries into blocks by the candidate length they
still need, both by range and of about equal size.  They meet in cells (part x block); a part that is
shorter than all needs of a block is never sent there.  A cell's memory is fixed, its rows are
vectors, never pairs, and the number of cells grows with rows times queries at most.

Edge cases: vectors that are null, or hold nulls or non-finite values, take no part; shorter
vectors count as padded with zeros; rows that share a vec_id are rows of their own, each a candidate
(and a query, if its id is one) and none the other's own; a row without an id is a candidate, last in
ties; scores beyond a long saturate; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import cut

SCALE = 256
PART_ROWS, BLOCK_QUERIES, STEP = 8192, 4096, 1024
SEEDS = 4096
HEAD = 16
#: Above one pair in so many left by the bounds, a step works out all its products in one.
DENSE = 32
SAFE = float(1 << 20)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as integers in doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    if len(flat) == len(column) * width:
        out[:] = flat.reshape(-1, width)
    elif len(flat):
        at = np.repeat(np.arange(len(column)), sizes)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether doubles hold every partial sum of the products."""
    return max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) <= SAFE and q.shape[1] <= 4096


def dots(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of rows pair by pair, saturated to longs."""
    if exact(q, c):
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist())]
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in out], np.int64)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best, by score, then smaller id."""
    order = np.lexsort((ids, -scores.astype(np.float64), rows)) if np.abs(scores).max(initial=0) < 2**53 else np.array(sorted(range(len(rows)), key=lambda x: (rows[x], -int(scores[x]), ids[x])), np.int64)
    first = np.r_[True, rows[order][1:] != rows[order][:-1]] if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    rank = at - np.maximum.accumulate(np.where(first, at, 0)) if len(order) else at
    return order[rank < k]


def search(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score) of each query's k best among the candidates that reach ``least``."""
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c_ids, c = c_ids[order], c[order]
    rq, rc = q @ turn, c @ turn
    head = min(HEAD, q.shape[1])
    q_rest, c_rest = np.linalg.norm(rq[:, head:], axis=1), np.linalg.norm(rc[:, head:], axis=1)
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    # Head product, Cauchy-Schwarz bound of the rest, and a margin for rounding, as one product.
    left = np.c_[rq[:, :head], q_rest, 1e-9 * q_len]
    right = np.c_[rc[:, :head], c_rest, c_len]
    safe = exact(q, c)
    least = least.astype(np.float64).copy()
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(c), STEP):
        part = slice(lo, lo + STEP)
        # Rounding of doubles stays far below these margins.
        live = np.flatnonzero(q_len * c_len[lo] * (1 + 1e-9) + 1e-6 >= least)
        if not len(live):
            break
        near = left[live] @ right[part].T >= least[live][:, None] - 1e-6
        if safe and np.count_nonzero(near) * DENSE > near.size:
            # Many pairs left: whole products at once, exact as long as doubles hold every partial sum.
            full = q[live] @ c[part].T
            a, b = np.nonzero(near & (full >= least[live][:, None]) & (q_ids[live][:, None] != c_ids[part]))
            new = full[a, b].astype(np.int64)
            a, b = live[a], b + lo
        else:
            a, b = np.nonzero(near)
            a, b = live[a], b + lo
            other = q_ids[a] != c_ids[b]
            a, b = a[other], b[other]
            new = np.concatenate([dots(q[a[x : x + 65536]], c[b[x : x + 65536]]) for x in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
            fit = new >= least[a]
            a, b, new = a[fit], b[fit], new[fit]
        rows, ids, scores = np.r_[rows, a], np.r_[ids, c_ids[b]], np.r_[scores, new]
        keep = best(rows, ids, scores, k)
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.bincount(rows, minlength=len(q)) >= k)
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, rows, scores.astype(np.float64))
        least[full] = np.maximum(least[full], worst[full])
    return rows, ids, scores


def reach(needs: list[float], lengths: list[float]) -> tuple[list[int], list[int]]:
    """How many blocks each part meets, and how many parts each block meets: always the first ones.

    ``needs`` ascend (the least length of a candidate that a block can take), ``lengths`` descend
    (each part's greatest).
    """
    blocks = [int(np.searchsorted(needs, x, side="right")) for x in lengths]
    return blocks, [sum(n > b for n in blocks) for b in range(len(needs))]


def merged(counts: list[int], size: int) -> np.ndarray:
    """A group for each of several neighbouring ranges, of ``size`` rows at most or of one range."""
    index, held = [], 0
    for n in counts:
        new = not index or held + n > size
        held = n if new else held + n
        index.append((index[-1] + 1 if index else 0) if new else index[-1])
    return np.array(index, np.int64)


def planned(rows: DataFrame, asked: DataFrame, n: int, nq: int) -> tuple[DataFrame, DataFrame]:
    """Candidates in parts by descending length and queries in blocks by ascending need, in the cells that can hold a result.

    A query needs candidates of length least / |q| (Cauchy-Schwarz), so a part meets the first blocks
    only and a block the first parts only.  Per part and block two numbers reach the driver.
    """
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, v: t + v * v))
    # Rounding only lowers a need: more cells, never fewer.
    need = F.when(norm > 0, F.greatest(F.lit(0.0), (F.col("least") - 2e-6) / norm * (1 - 1e-8))).otherwise(F.lit(0.0))

    def ranged(df: DataFrame, count: int, *order: F.Column) -> DataFrame:
        return cut(df.repartitionByRange(count, *order).withColumn("place", F.spark_partition_id()))

    parts = ranged(rows.select("vec_id", "v", "len2"), max(1, -(-n // PART_ROWS)), F.desc("len2"), F.xxhash64("vec_id"))
    blocks = ranged(asked.withColumn("need", need), max(1, -(-nq // BLOCK_QUERIES)), F.col("need"), F.xxhash64("vec_id"))
    longest = parts.groupBy("place").agg(F.sqrt(F.max("len2")).alias("x"), F.count("*").alias("n")).orderBy("place").toPandas()
    least = blocks.groupBy("place").agg(F.min("need").alias("x"), F.count("*").alias("n")).orderBy("place").toPandas()
    part, block = merged(longest["n"].tolist(), PART_ROWS), merged(least["n"].tolist(), BLOCK_QUERIES)
    meets, met = reach((least["x"] * (1 - 1e-9)).groupby(block).min().tolist(), longest["x"].groupby(part).max().tolist())

    def dealt(df: DataFrame, places: pd.Series, index: np.ndarray, count: list[int], own: str, other: str) -> DataFrame:
        table = spark.createDataFrame([(int(x), k, count[k]) for x, k in zip(places, index.tolist()) if count[k]], f"place int, {own} bigint, m bigint")
        return df.join(F.broadcast(table), "place").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).drop("place", "m")

    return dealt(parts.drop("len2"), longest["place"], part, meets, "p", "b"), dealt(blocks.drop("need"), least["place"], block, met, "b", "p")


def top_k(vectors: DataFrame, queries: F.Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``vectors`` (vec_id, embedding), itself excepted."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))
    rows = rows.withColumn("is_query", F.coalesce(queries, F.lit(False))).withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    # Every row gets an identity in the order of ids, so ties go by it; from here on ``vec_id`` is that identity.
    ordered = rows.withColumn("spread", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("vec_id"), "spread").drop("spread")
    rows = cut(ordered.withColumn("own_id", F.col("vec_id")).withColumn("vec_id", F.monotonically_increasing_id()))
    shape = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("nq"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not shape["nq"] or not shape["width"]:
        return rows.sparkSession.createDataFrame([], schema)
    width = shape["width"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width)
            m = m / np.maximum(1.0, np.linalg.norm(m, axis=1))[:, None]
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "x"])

    cells = rows.select("v").mapInArrow(moments, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros(width * width)
    gram[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    turn = np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()
    longest = rows.orderBy(F.desc("len2"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    seeds = rows.sparkSession.sparkContext.broadcast((longest["vec_id"].to_numpy(), matrix(longest["v"], width), turn))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors_, turn_ = seeds.value
        for batch in batches:
            q = matrix(batch.column(1), width)
            at, _, scores = search(batch.column(0).to_numpy(), q, np.full(len(q), -np.inf), ids, vectors_, turn_, k)
            least = np.full(len(q), np.inf)
            np.minimum.at(least, at, scores.astype(np.float64))
            least[np.bincount(at, minlength=len(q)) < k] = -np.inf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], ["vec_id", "v", "least"])

    asked = cut(rows.where("is_query").select("vec_id", "v").repartition(max(1, -(-shape["nq"] // 512)), "vec_id").mapInArrow(thresholds, "vec_id bigint, v array<double>, least double"))
    left, right = planned(rows, asked, shape["n"], shape["nq"])

    def cell(c: pa.Table, q: pa.Table) -> pa.Table:
        ids = q["vec_id"].to_numpy()
        at, found, scores = search(ids, matrix(q["v"], width), q["least"].to_numpy(), c["vec_id"].to_numpy(), matrix(c["v"], width), seeds.value[2], k) if len(q) and len(c) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(ids[at], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    near = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    of = rows.select("vec_id", "own_id")
    named = best.join(of.select(F.col("vec_id").alias("query_id"), F.col("own_id").alias("asked")), "query_id").join(of, "vec_id")
    return named.select(F.col("asked").alias("query_id"), "rank", F.col("own_id").alias("vec_id"), "score")
