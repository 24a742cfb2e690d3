"""Toxic passages as maximal-scoring segments of token log-odds.

Fitting counts hashed features (a word and its beginnings of 4, 5 and 6 bytes) in toxic and in
clean training texts.  Log-odds have a Dirichlet prior in proportion to the pooled counts and are
shrunk by their standard error; a word scores its best feature minus DRIFT, so clean text drifts
downwards, and a word scores the same wherever it stands; only the counts take a word once a text.
A linear scan (Ruzzo and Tompa, 1999) finds all maximal segments.  A segment of score
S in a text of n words has the normalised score lambda * S - ln(K * n) (Karlin and Altschul, 1990),
whose tail under clean text is an extreme-value law; those above zero add up, and a logistic curve
turns the sum into a probability.  The curve learns from all segments of the sample, each half
scored by the other half's table.

The fit reads at most SAMPLE_ROWS labelled rows, those with the least hash of their id; scoring
reads all rows.  Features met once in the sample carry no score.  Tables have a fixed size (SLOTS), so what is broadcast does not grow.

Edge cases: a null or empty text has no segment and gets the curve's base value; without labelled
rows of both kinds every score is 0; of several labels of one id the greatest counts; null labels
are no labels; repeated rows come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.scratch import bounded_batches

SLOTS = 1 << 20
SAMPLE_ROWS = 20_000
BEGINNINGS = (4, 5, 6)
#: The prior weighs as much as this share of the toxic class.  This and the next three are chosen by
#: cross-validation inside the training rows (toxicity_choice): least sum of log losses on 3,000 and
#: 300 rows.
PRIOR_SHARE = 2.0
SHRINK = 1.5
DRIFT = 0.5
TOP = 6.0
CUTOFF = 0.3
BINS = 128
UNIT = 1 << 20


@dataclass
class Model:
    table: np.ndarray
    scale: float
    log_k: float
    curve: np.ndarray


def word_slots(buf: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots of each word, the words' starts and ends, and each text's range among them."""
    low = tk.LOWER[buf]
    starts, ends, ranges = tk.words(low, bounds, tk.ALNUM_LOWER)
    sums = tk.prefix_sums(low)
    whole = tk.span_hashes(sums, starts, ends)
    features = [whole]
    for n in BEGINNINGS:
        features.append(np.where(ends - starts > n, tk.span_hashes(sums, starts, np.minimum(starts + n, ends)) ^ tk.U64(n), whole))
    return [(f >> tk.U64(44)).astype(np.int64) for f in features], starts, ends, ranges


def again(slots: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each word stood before in the same text."""
    key = doc * SLOTS + slots
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    at = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def word_scores(slots: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Each word's best feature minus DRIFT."""
    best = table[slots[0]]
    for s in slots[1:]:
        best = np.maximum(best, table[s])
    return best - np.float32(DRIFT)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last + 1, score), best first, of one text's word scores."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.r_[0.0, np.cumsum(scores, dtype=np.float64)]
    found: list[list[float]] = []
    for k in up.tolist():
        first, left, right = k, sums[k], sums[k + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([first, k + 1, left, right, j])
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return sorted(((int(a), int(b), r - l) for a, b, l, r, _ in found), key=lambda x: (-x[2], x[0]))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    pooled = toxic + clean
    total = pooled.sum()
    if not toxic.sum() or not clean.sum():
        return np.zeros(len(toxic), np.float32)
    prior = PRIOR_SHARE * toxic.sum() * pooled / total + 0.01
    a0 = prior.sum()
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (toxic.sum() + a0 - a)) - np.log(b / (clean.sum() + a0 - b))
    error = np.sqrt(1 / a + 1 / b)
    sure = np.sign(delta) * np.maximum(0, np.abs(delta) - SHRINK * error)
    return np.clip(sure, -1, TOP).astype(np.float32)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slot by half and label (columns text, half, toxic)."""
    counts = np.zeros((4, SLOTS), np.int32)
    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, buf, bounds in tk.parts(batch.column(0)):
            slots, _, _, ranges = word_slots(buf, bounds)
            doc = np.repeat(np.arange(lo, hi), np.diff(ranges))
            once = again(slots[0], doc) == 0
            slots, of = [s[once] for s in slots], kind[doc[once]]
            for which in range(4):
                mine = of == which
                if mine.any():
                    for k, s in enumerate(slots):
                        new = mine if k == 0 else mine & (s != slots[0])
                        counts[which] += np.bincount(s[new], minlength=SLOTS).astype(np.int32)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c[used].astype(np.int64)) for c in counts)], ["slot", "n0", "n1", "n2", "n3"])


def halves_scored(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(label, word scores by the other half's table) of sample texts (columns text, half, toxic)."""
    for batch in batches:
        half, toxic = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        rows = []
        for lo, hi, buf, bounds in tk.parts(batch.column(0)):
            slots, _, _, ranges = word_slots(buf, bounds)
            both = [word_scores(slots, t) for t in tables]
            rows += [(int(toxic[lo + d]), both[1 - half[lo + d]][ranges[d] : ranges[d + 1]]) for d in range(hi - lo)]
        yield rows


def best_batches(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums over clean sample texts as (what, amount): a histogram of word scores (0 to BINS - 1), the number
    of texts, and in units of 1 / UNIT their best segment scores and the logarithms of their lengths.

    Whole numbers, so that neither batches nor the order of tasks change the law.
    """
    for rows in halves_scored(batches, tables):
        sums = np.zeros(BINS + 3, np.int64)
        for own in (own for toxic, own in rows if not toxic):
            sums[:BINS] += np.histogram(own, BINS, (-1 - DRIFT, TOP))[0]
            sums[BINS:] += [1, round(next((x[2] for x in segments(own)), 0.0) * UNIT), round(np.log(max(1, len(own))) * UNIT)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 3)), pa.array(sums)], ["what", "amount"])


def evidence_batches(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray], model: Model) -> Iterator[pa.RecordBatch]:
    """Labels and evidence, from all segments, of sample texts."""
    for rows in halves_scored(batches, tables):
        found = [evidence([x[2] for x in segments(own)], len(own), model) for _, own in rows]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "evidence"])


def decay(bins: np.ndarray) -> float:
    """The lambda above 0 at which the mean of exp(lambda * score) is 1."""
    share = bins / max(1, bins.sum())
    values = np.linspace(-1 - DRIFT, TOP, BINS + 1)
    values = (values[1:] + values[:-1]) / 2
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (share * np.exp(mid * values)).sum() > 1 else (mid, hi)
    return lo


def evidence(scores: np.ndarray, words: int, model: Model) -> list[float]:
    """What the curve weighs: the best and the sum of the normalised scores above zero, and the length."""
    x = model.scale * np.asarray(scores, float) - model.log_k - np.log(max(1, words))
    x = x[x > 0]
    return [1.0, np.log1p(x.max(initial=0.0)), np.log1p(x.sum()), np.log1p(words)]


def probability(rows: list[list[float]], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array(rows, float).reshape(-1, 4) @ model.curve, -500, 500)))


def tables_of(table: pd.DataFrame) -> tuple[Model, list[np.ndarray]]:
    """A model without a law yet, and each half's table, from the counts of ``count_batches``."""
    counts = np.zeros((4, SLOTS), np.float32)
    counts[:, table["slot"].to_numpy(np.int64)] = table[["n0", "n1", "n2", "n3"]].to_numpy(np.float32).T
    halves = [log_odds(counts[1], counts[0]), log_odds(counts[3], counts[2])]
    return Model(log_odds(counts[1] + counts[3], counts[0] + counts[2]), 1.0, 0.0, np.array([-500.0, 0, 0, 0])), halves


def fit_law(model: Model, sums: pd.DataFrame) -> None:
    """Lambda and K of the extreme-value law, from the sums of ``best_batches``."""
    found = np.bincount(sums["what"], sums["amount"], BINS + 3)
    model.scale = decay(found[:BINS])
    texts, best, lengths = found[BINS:]
    model.log_k = float((model.scale * best - lengths) / UNIT / texts - np.euler_gamma) if texts else 0.0


def fit_curve(model: Model, seen: pd.DataFrame) -> None:
    """The logistic curve, from ``evidence_batches``."""
    design = np.array(seen["evidence"].tolist(), float).reshape(-1, 4)
    y, w, ridge = seen["toxic"].to_numpy(float), np.zeros(4), np.array([1e-3, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge)
        w += np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
    model.curve = w


def fit(docs: DataFrame, labels: DataFrame, training: F.Column | None = None) -> Model:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs``; ``training``: which labels may be read."""
    bounded_batches(docs)
    rows = labels.where("doc_id is not null and toxic is not null")
    rows = rows.where(training) if training is not None else rows
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "half", "toxic")
    table = sample.mapInArrow(count_batches, "slot bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("slot").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    table = table.where("n0 + n1 + n2 + n3 > 1").toPandas()
    model, halves = tables_of(table)
    if not model.table.any():
        return model
    shared = docs.sparkSession.sparkContext.broadcast(halves)
    sums = sample.mapInArrow(lambda b: best_batches(b, shared.value), "what bigint, amount bigint").groupBy("what").agg(F.sum("amount").alias("amount"))
    fit_law(model, sums.toPandas())
    law = Model(np.zeros(0, np.float32), model.scale, model.log_k, model.curve)
    fit_curve(model, sample.mapInArrow(lambda b: evidence_batches(b, shared.value, law), "toxic bigint, evidence array<double>").toPandas())
    return model


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, spans: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, passages = [], []
        for lo, hi, buf, bounds in tk.parts(batch.column(1)):
            slots, starts, ends, ranges = word_slots(buf, bounds)
            scores = word_scores(slots, model.table)
            for d in range(hi - lo):
                found = segments(scores[ranges[d] : ranges[d + 1]])
                n = int(ranges[d + 1] - ranges[d])
                sums.append(evidence(np.array([s[2] for s in found]), n, model))
                if spans:
                    base, zero = ranges[d], bounds[d]
                    passages.append([{"start": int(starts[base + a] - zero), "end": int(ends[base + b - 1] - zero), "score": float(model.scale * s - model.log_k - np.log(max(1, n)))} for a, b, s in found if model.scale * s - model.log_k - np.log(max(1, n)) > 0])
        out = [batch.column(0), pa.array(np.round(probability(sums, model), 9), pa.float64())]
        if spans:
            out.append(pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "passages"][: len(out)])


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, score) for each row; with ``spans`` the significant passages too (UTF-8 byte offsets)."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)
    more = ", passages array<struct<start:bigint,end:bigint,score:double>>" if spans else ""
    return docs.select("doc_id", "text").mapInArrow(lambda b: score_batches(b, shared.value, spans), "doc_id bigint, score double" + more)


def keep_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["doc_id", "text"])
        scores = next(score_batches(iter([pair]), model)).column(1).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(scores < CUTOFF))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below CUTOFF, all columns as they were."""
    shared, at = bounded_batches(docs).sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lambda b: keep_batches(b, shared.value, at), docs.schema)


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2
