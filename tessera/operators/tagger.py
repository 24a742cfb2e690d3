"""Entity spans by a sequence tagger: an averaged perceptron whose parameters are mixed over partitions.

A sentence's tokens get the tags outside, first and inside of a span.  Each pass starts every part of
the training rows from the same weights; a part runs the perceptron over its sentences and gives back
whole numbers of updates, which Spark adds up by slot, so the sum and the model do not depend on the
order of tasks.  Parts are cut by a digest of the document, not by the cluster.  Features are hashed
to SLOTS, which bounds weights, what is broadcast and what comes back.  Decoding is Viterbi's.

Edge cases: null and empty texts have no spans; spans that meet no token, or fall outside their text,
teach nothing; a sentence ends at ``.``, ``!``, ``?``, a line break, or after SENTENCE tokens; without
training rows every token is outside.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tokens import dealt

OUTSIDE, FIRST, INSIDE = 0, 1, 2
TAGS = 3
SLOTS = 1 << 18
SENTENCE = 80
#: Averages are counted in parts of this size.
UNIT = 1 << 20

_TOKEN = re.compile(r"\w+")
_END = re.compile(r"[.!?\n]")
#: Words whose slots a worker keeps from one text to the next, and code points and tokens that it reads and scores at once.
WORDS = 1 << 18
CHUNK = 1 << 17


@dataclass(frozen=True)
class Model:
    """``weights``: slot by tag; ``steps``: tag after tag, the last row for a sentence's first tag."""

    weights: np.ndarray
    steps: np.ndarray


def blank() -> Model:
    return Model(np.zeros((SLOTS, TAGS)), np.zeros((TAGS + 1, TAGS)))


class _Letters(dict):
    """What a character is in a word's shape."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.islower() else "d" if c.isdigit() else "-"
        return kind


_letters = _Letters()


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % SLOTS


@lru_cache(maxsize=1 << 14)
def _shape_slots(letters: str) -> tuple[int, int, int]:
    shape = re.sub(r"(.)\1+", r"\1", letters)
    return _slot("s", shape), _slot("-s", shape), _slot("+s", shape)


_prefix_slot = lru_cache(maxsize=1 << 16)(lambda value: _slot("p", value))
_suffix_slot = lru_cache(maxsize=1 << 16)(lambda value: _slot("e", value))
_BIAS = _slot("b", "")
#: A checksum goes on from that of its beginning.
_HERE, _BEFORE, _AFTER = (zlib.crc32(f"{kind}=".encode()) for kind in ("w", "-w", "+w"))


def _slots(word: str) -> list[int]:
    """Slots of a word where it stands (five), before it (two) and after it (two)."""
    shape, before, after = _shape_slots(word[:30].translate(_letters))
    low = word.lower()
    code = low.encode()
    here, left, right = (zlib.crc32(code, start) % SLOTS for start in (_HERE, _BEFORE, _AFTER))
    return [here, shape, _prefix_slot(low[:3]), _suffix_slot(low[-3:]), _BIAS, left, before, right, after]


class _Words(dict):
    """The row of each word in ``table``, whose first row is for no word."""

    def __init__(self) -> None:
        self.table = np.zeros((1 << 10, 9), np.int32)
        self.table[0] = _slots("")

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self) + 1
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = _slots(word)
        return at


_words = _Words()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 1 for those of tokens, 2 for the ends of sentences, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.int8)
    # Surrogates are in no token, nor can a text of Spark's hold any.
    for low, high in ((0, 0xD800), (0xE000, sys.maxunicode + 1)):
        whole = "".join(map(chr, range(low, high)))
        for m in _TOKEN.finditer(whole):
            out[low + m.start() : low + m.end()] = 1
    out[[ord(c) for c in ".!?\n"]] = 2
    return out


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, firsts): where tokens start and end, and which of them are the first of a sentence, by number."""
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff((kinds == 1).astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, starts
    stops = np.searchsorted(np.flatnonzero(kinds == 2), starts)
    first = np.r_[True, stops[1:] != stops[:-1]]
    numbers = np.arange(len(starts))
    begun = np.maximum.accumulate(np.where(first, numbers, 0))
    return starts, ends, np.flatnonzero((numbers - begun) % SENTENCE == 0)


def sentences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Each sentence's tokens as (start, end)."""
    starts, ends, firsts = cut(text)
    tokens = list(zip(starts.tolist(), ends.tolist()))
    yield from (tokens[a:b] for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(tokens)]))


def features(text: str, starts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Slots of each token: its own, and of those before and after it in its sentence."""
    if len(_words) > WORDS:
        _words.clear()
    at = np.fromiter(map(_words.__getitem__, _TOKEN.findall(text)), np.int64, len(starts))
    before, after = np.r_[0, at[:-1]], np.r_[at[1:], 0]
    before[firsts], after[firsts[1:] - 1] = 0, 0
    table = _words.table
    return np.concatenate([table[at, :5], table[before, 5:7], table[after, 7:]], axis=1)


def truth(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """The tags of a sentence's tokens, given spans (start, end) in order."""
    starts, ends = np.array(tokens, np.int64).reshape(-1, 2).T
    return _truth(starts, ends, np.arange(min(len(starts), 1)), spans)


def _truth(starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tags of a text's tokens."""
    out = np.zeros(len(starts), np.int64)
    if not spans or not len(starts):
        return out
    opened, closed = np.array(spans, np.int64).T
    k = np.searchsorted(np.maximum.accumulate(closed), starts, side="right")
    known = np.minimum(k, len(spans) - 1)
    held = (k < len(spans)) & (opened[known] <= starts) & (ends <= closed[known])
    follows = np.r_[False, held[:-1] & (starts[:-1] >= opened[known[1:]])]
    follows[firsts] = False
    out[held] = np.where(follows[held], INSIDE, FIRST)
    return out


def _steps(steps: np.ndarray) -> list[list[float]]:
    """Steps as they are allowed: inside never comes first or after outside."""
    allowed = np.array(steps, float)
    allowed[OUTSIDE, INSIDE] = allowed[TAGS, INSIDE] = -np.inf
    return allowed.tolist()


def _decoded(scores: list[list[float]], allowed: list[list[float]]) -> list[int]:
    """Viterbi over plain numbers, the three tags written out: arrays of three are slower than their numbers."""
    (oo, of, oi), (fo, ff, fi), (io, if_, ii), (so, sf, si) = allowed
    o, f, i = scores[0]
    o, f, i = so + o, sf + f, si + i
    back = []
    for x, y, z in scores[1:]:
        a, p = o + oo, 0
        if f + fo > a:
            a, p = f + fo, 1
        if i + io > a:
            a, p = i + io, 2
        b, q = o + of, 0
        if f + ff > b:
            b, q = f + ff, 1
        if i + if_ > b:
            b, q = i + if_, 2
        c, r = o + oi, 0
        if f + fi > c:
            c, r = f + fi, 1
        if i + ii > c:
            c, r = i + ii, 2
        o, f, i = a + x, b + y, c + z
        back.append((p, q, r))
    tag = 0 if o >= f and o >= i else 1 if f >= i else 2
    out = [tag]
    for ways in reversed(back):
        tag = ways[tag]
        out.append(tag)
    return out[::-1]


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The tags of the highest sum of scores and steps; the lower tag on ties; inside never comes first or after outside."""
    return np.array(_decoded(np.asarray(scores, float).tolist(), _steps(steps)), np.int64)


def _scores(weights: np.ndarray, x: np.ndarray) -> list[list[float]]:
    """Sums of weights, in the order of the slots."""
    return np.add.reduce(weights.take(x, axis=0), axis=1).tolist()


def _joined(rows: Iterator[tuple]) -> Iterator[tuple[str, list[int], list[tuple]]]:
    """(text, offsets, rows): rows whose first value is a text, about CHUNK code points of them in one text; a line break between two ends a sentence."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[0]) + 1
        if size >= CHUNK:
            yield _laid(held)
            held, size = [], 0
    if held:
        yield _laid(held)


def _laid(rows: list[tuple]) -> tuple[str, list[int], list[tuple]]:
    sizes = [len(r[0]) + 1 for r in rows]
    return "\n".join(r[0] for r in rows), np.cumsum([0, *sizes[:-1]]).tolist(), rows


def spans_of(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each span found, in order."""
    starts, ends, firsts = cut(text)
    if not len(starts):
        return []
    x, allowed = features(text, starts, firsts), _steps(model.steps)
    tags: list[int] = []
    # Whole sentences, about CHUNK tokens at once.
    for cuts in np.split(firsts, np.flatnonzero(np.diff(firsts // CHUNK)) + 1):
        low = int(cuts[0])
        at = int(np.searchsorted(firsts, cuts[-1], side="right"))
        high = int(firsts[at]) if at < len(firsts) else len(starts)
        scores = _scores(model.weights, x[low:high])
        bounds = [*(cuts - low).tolist(), high - low]
        for a, b in zip(bounds, bounds[1:]):
            tags += _decoded(scores[a:b], allowed)
    found = np.array(tags)
    begin = np.flatnonzero(found == FIRST)
    # A span ends with the last token inside it before the next one that is not.
    other = np.r_[np.flatnonzero(found != INSIDE), len(found)]
    last = other[np.searchsorted(other, begin, side="right")] - 1
    return list(zip(starts[begin].tolist(), ends[last].tolist()))


def spans_of_rows(rows: Iterator[tuple], model: Model) -> Iterator[tuple]:
    """(row, start, end) of each span found in the texts of rows, a row's first value; short texts are read many at once."""
    for text, offsets, held in _joined(rows):
        found = spans_of(text, model)
        whose = np.searchsorted(offsets, [a for a, _ in found], side="right") - 1
        yield from ((held[k], a - offsets[k], b - offsets[k]) for k, (a, b) in zip(whose.tolist(), found))


def learnt(rows: Iterator[tuple[str, list[tuple[int, int]]]], model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass: (updates by row of weights and steps, the same as the mean over the pass sees them in parts of 1 / UNIT, sentences)."""
    base = np.concatenate([model.weights, model.steps])
    size, seen = len(base), 0
    delta, late, now = np.zeros((size, TAGS)), np.zeros((size, TAGS)), base.copy()
    allowed = _steps(now[SLOTS:])
    for text, offsets, held in _joined(rows):
        starts, ends, firsts = cut(text)
        if not len(starts):
            continue
        # No span may reach into another row's text.
        spans = [(k + max(a, 0), k + min(b, len(t))) for k, (t, marks) in zip(offsets, held) for a, b in marks]
        slots, tags = features(text, starts, firsts), _truth(starts, ends, firsts, spans)
        known, bounds = tags.tolist(), [*firsts.tolist(), len(starts)]
        # Scores are made for more sentences at once while none is wrong; a wrong one makes those that follow void.
        scores, begun, ahead = [], 0, 1
        for n, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if high - begun > len(scores):
                scores, begun = _scores(now, slots[low : bounds[min(n + ahead, len(bounds) - 1)]]), low
                ahead = min(2 * ahead, 1 << 10)
            found = _decoded(scores[low - begun : high - begun], allowed)
            if found != known[low:high]:
                x, right, got = slots[low:high], tags[low:high], np.array(found)
                wrong = np.flatnonzero(got != right)
                own = x[wrong] * TAGS
                before = [TAGS * (SLOTS + np.concatenate([[TAGS], path[:-1]])) for path in (right, got)]
                at = np.concatenate([(own + right[wrong, None]).ravel(), before[0] + right, (own + got[wrong, None]).ravel(), before[1] + got])
                sign = np.ones(len(at))
                sign[len(at) // 2 :] = -1
                # Whole numbers: their sums don't depend on the order.
                np.add.at(delta.reshape(-1), at, sign)
                np.add.at(late.reshape(-1), at, sign * seen)
                moved = x[wrong].ravel()
                now[moved] = base[moved] + delta[moved]
                now[SLOTS:] = base[SLOTS:] + delta[SLOTS:]
                allowed, scores, ahead = _steps(now[SLOTS:]), [], 1
            seen += 1
    mean = np.rint((delta - late / max(seen, 1)) * UNIT)
    return delta, mean, seen


def _lesson(shared: Broadcast) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _lesson_of(table, shared.value)


def _lesson_of(table: pa.Table, model: Model) -> pa.Table:
    rows = sorted(zip(table["doc_key"].to_pylist(), table["text"].to_pylist(), table["spans"].to_pylist(), strict=True), key=lambda r: r[0])
    pairs = ((text, [(s["start"], s["end"]) for s in spans]) for _, text, spans in rows)
    delta, mean, _ = learnt(pairs, model)
    slot = np.flatnonzero((delta != 0).any(axis=1) | (mean != 0).any(axis=1))
    cols = [pa.array(slot), *(pa.array(m[slot, t].astype(np.int64)) for m in (delta, mean) for t in range(TAGS))]
    return pa.Table.from_arrays(cols, ["slot", *(f"{c}{t}" for c in "dm" for t in range(TAGS))])


def train(docs: DataFrame, spans: DataFrame, passes: int = 3, part_docs: int = 500) -> Model:
    """A tagger from documents (doc_id, text) and their spans (doc_id, start, span).

    Each part has about ``part_docs`` documents, told by a digest; a pass is one job whose result has a row a slot at most.
    """
    marks = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.length("span")).alias("end")))).alias("spans"))
    rows = docs.select("doc_id", "text").where("text is not null").join(marks, "doc_id", "left")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").cast("binary"))
    parts = max(1, docs.count() // part_docs)
    dealt = rows.select(key.alias("doc_key"), "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")).withColumn("part", F.pmod(F.xxhash64("doc_key"), F.lit(parts)))
    model, mean = blank(), None
    columns = [f"{c}{t}" for c in "dm" for t in range(TAGS)]
    for _ in range(passes):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        lessons = dealt.groupBy("part").applyInArrow(_lesson(shared), "slot bigint, " + ", ".join(f"{c} bigint" for c in columns))
        sums = lessons.groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        slot = sums["slot"].to_numpy(np.int64)
        whole = np.concatenate([model.weights, model.steps])
        mean = whole.copy()
        mean[slot] += sums[columns[TAGS:]].to_numpy(np.float64) / UNIT / parts
        whole[slot] += sums[columns[:TAGS]].to_numpy(np.float64) / parts
        model = Model(whole[:SLOTS], whole[SLOTS:])
        shared.unpersist()
    return model if mean is None else Model(mean[:SLOTS], mean[SLOTS:])


def recognise(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, span, start) of every span the tagger finds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, t[a:b], a) for (t, i), a, b in spans_of_rows(zip(batch["text"], batch["doc_id"], strict=True), shared.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "span", "start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Texts are dealt out first: a file of few row groups would keep few cores busy.
    return dealt(docs.select("doc_id", "text").where("text is not null and doc_id is not null"), "doc_id").mapInPandas(found, f"doc_id {kind}, span string, start int")


def quality(found: DataFrame, spans: DataFrame) -> DataFrame:
    """n_found, n_spans, n_right, p, r: spans that agree in place and words."""
    keys = ["doc_id", "start", "span"]
    both = found.select(*keys, F.lit(1).alias("f")).join(spans.select(*keys, F.lit(1).alias("s")), keys, "full")
    sums = both.agg(F.count("f").alias("n_found"), F.count("s").alias("n_spans"), F.count(F.col("f") + F.col("s")).alias("n_right"))
    return sums.withColumn("p", F.coalesce(F.try_divide("n_right", "n_found"), F.lit(0.0))).withColumn("r", F.coalesce(F.try_divide("n_right", "n_spans"), F.lit(0.0)))
