"""Removal of repeated byte strings through suffix arrays of shards.

Every window of WINDOW bytes has an anchor: its 32-byte substring of least hash.  Equal windows
have equal anchors, so windows that share an anchor's hash meet in one shard, and no others need
to.  A run of windows with the same anchor place travels as one context of at most twice WINDOW
bytes; of the contexts with equal hashes (a class) the first and the last travel, with their number.
In a shard the contexts are sorted by induced suffix sorting (``suffix_arrays``); a window repeats
where the common prefix with a neighbour in the array reaches WINDOW.  What the array finds in a
class's first context holds for the class.

An anchor with more than HOT different contexts (many near copies of one passage) is cut up: each
context into pieces of PIECE windows, keyed by the bytes that all windows of the piece share, and
equal pieces are merged again; where even those are too many, single windows are counted by hash.
The classes of such an anchor are spread over the shards.  So no shard gathers an unbounded group.

Hashes only route: of anchors (64 bits), of contexts within an anchor (64 more).  An anchor that
stands once tells that its windows do not repeat; the arrays decide all others but the pieces and
windows just named.

Edge cases: null texts are empty; texts shorter than WINDOW keep every byte; a text that overlaps
itself counts, runs of one letter included; rows that repeat are documents of their own, so they
cover each other; null ids are kept as they are; texts are taken to be valid UTF-8; very long texts
are read in sections of SECTION bytes that overlap by a window; of rows with equal ids and texts
that follow each other two travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.scratch import bounded_batches, by_list, cut
from tessera.llm.suffix_arrays import permuted_prefixes, suffix_array

WINDOW, GRAM = 400, 32
SIDE = (WINDOW - GRAM) // 2
SECTION = 1 << 20
HOT, PIECE = 256, 32
SHARD_BYTES = 1 << 20
POSITION_BITS = 22

ANCHOR_SCHEMA = "id bigint, tk bigint, start bigint, n_win bigint, anchor bigint, context bigint"
PIECE_COLUMNS = ["id", "tk", "start", "n_win", "n", "anchor", "context", "bytes"]
PIECE_SCHEMA = "id bigint, tk bigint, start bigint, n_win bigint, n bigint, anchor bigint, context bigint, bytes binary"
SPAN_SCHEMA = "id bigint, tk bigint, n bigint, lo bigint, hi bigint, anchor bigint, context bigint"


def sections(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, bytes, bounds): whole texts, or an overlapping section of a long one."""
    for lo, _, buf, bounds in tk.parts(column):
        if len(buf) < SECTION + WINDOW * 2 or len(bounds) > 2:
            yield lo, 0, buf, bounds
            continue
        for at in range(0, len(buf) - WINDOW + 1, SECTION):
            piece = buf[at : at + SECTION + WINDOW - 1]
            yield lo, at, piece, np.array([0, len(piece)], np.int64)


def grams_of(sums: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on."""
    power, _ = tk.powers(len(sums))
    return tk.mix((sums[GRAM:] - sums[:-GRAM]) * power[: len(sums) - GRAM])


def window_anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's hash and anchor's place of each run."""
    n, width = len(buf), WINDOW - GRAM + 1
    grams = grams_of(tk.prefix_sums(buf))
    m = len(grams)
    low = tk.U64((1 << POSITION_BITS) - 1)
    keys = np.full(-(-m // width) * width, ~tk.U64(0), tk.U64)
    keys[:m] = (grams & ~low) | np.arange(m, dtype=tk.U64)
    grid = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    crossing = np.zeros(windows + 1, np.int32)
    inner = bounds[(bounds > 0) & (bounds < n)]
    np.add.at(crossing, np.minimum(np.maximum(inner - WINDOW + 1, 0), windows), 1)
    np.add.at(crossing, np.minimum(inner, windows), -1)
    whole = np.cumsum(crossing[:-1]) == 0
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    ended = whole.copy()
    ended[:-1] &= ~whole[1:] | (place[1:] != place[:-1])
    return first, np.flatnonzero(ended) - first + 1, grams[place[first]].view(np.int64), place[first]


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, at, buf, bounds in sections(batch.column(2)):
            if len(buf) < WINDOW:
                continue
            first, count, anchor, _ = window_anchors(buf, bounds)
            doc = np.searchsorted(bounds, first, "right") - 1
            view = memoryview(buf)
            context = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist())], np.uint64).view(np.int64)
            rows = pa.array(lo + doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - bounds[doc] + at), pa.array(count), pa.array(anchor), pa.array(context)], ["id", "tk", "start", "n_win", "anchor", "context"])


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for (id, tk, text, asked)."""
    row, times = None, 0
    for batch in batches:
        asked = batch.column(3)
        rows: list[list] = [[] for _ in range(8)]
        size = 0
        for i in np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False)).tolist():
            key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            row, times = key, times + 1 if key == row else 1
            if times > 2:
                continue
            raw = batch.column(2)[i].as_buffer()
            view = memoryview(raw) if raw is not None else memoryview(b"")
            for x in asked[i].as_py():
                piece = bytes(view[x["start"] : x["start"] + x["n_win"] + WINDOW - 1])
                for c, v in zip(rows, (*key, x["start"], x["n_win"], x["n"], x["anchor"], x["context"], piece)):
                    c.append(v)
                size += len(piece)
            if size > 8 << 20:
                yield contexts(rows)
                rows, size = [[] for _ in range(8)], 0
        yield contexts(rows)


def contexts(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:7]), pa.array(rows[7], pa.binary())], PIECE_COLUMNS)


def piece_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut into pieces of ``size`` windows, counted from the anchor; the key holds what they share."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(8)]
        for i in range(len(batch)):
            raw = batch.column(7)[i].as_py()
            ids = [batch.column(c)[i].as_py() for c in range(6)]
            start, count = ids[2], ids[3]
            buf = np.frombuffer(raw, np.uint8)
            # The anchor of the context's windows, found again; pieces are counted from it.
            first, runs, _, place = window_anchors(buf, np.array([0, len(buf)], np.int64))
            for f, r, p in zip(first.tolist(), runs.tolist(), place.tolist()):
                for q in range((p - (f + r - 1)) // size, (p - f) // size + 1):
                    a, b = max(f, p - q * size - size + 1), min(f + r - 1, p - q * size)
                    core = raw[max(0, p - q * size) : p - q * size - size + 1 + WINDOW]
                    piece = raw[a : b + WINDOW]
                    key = xxhash.xxh3_64_intdigest(core, q & 0xFFFF)
                    for c, v in zip(rows, (ids[0], ids[1], start + a, b - a + 1, ids[4], signed(key), signed(xxhash.xxh3_64_intdigest(piece)), piece)):
                        c.append(v)
        yield contexts(rows)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def may_repeat(raw: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """Contexts that can share a window with another one of the shard.

    A window reaches at least SIDE bytes to the left or to the right of its anchor, so of two contexts
    that share one these bytes are equal.  A context whose key is no anchor's hash (a piece) may repeat.
    """
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    may = np.ones(len(raw), bool)
    if len(buf) < GRAM:
        return may
    sums = tk.prefix_sums(buf)
    at = np.flatnonzero(grams_of(sums).view(np.int64) == np.repeat(anchor, sizes)[: len(buf) - GRAM + 1])
    own = np.searchsorted(ends, at, "right")
    whole = at + GRAM <= ends[own]
    own, first = np.unique(own[whole], return_index=True)
    at = at[whole][first]
    may[own] = False
    for lo, hi in ((at - SIDE, at + GRAM), (at, at + GRAM + SIDE)):
        inside = np.flatnonzero((lo >= ends[own] - sizes[own]) & (hi <= ends[own]))
        _, same, times = np.unique(tk.span_hashes(sums, lo[inside], hi[inside]), return_inverse=True, return_counts=True)
        may[own[inside[times[same] > 1]]] = True
    return may


def shard_spans(table: pa.Table) -> pa.Table:
    """Windows that stand elsewhere in the shard, as spans of first bytes.

    Spans of a single context (n = 1) count from its text's beginning, those of a class from the context's.
    """
    # Equal contexts stand side by side, so that what two places share ends soon and ranks part early.
    table = table.combine_chunks().sort_by([("anchor", "ascending"), ("context", "ascending")])
    raw = [x.as_py() for x in table["bytes"]]
    may = may_repeat(raw, table["anchor"].to_numpy()) | (table["n"].to_numpy() > 1)
    table, raw = table.filter(pa.array(may)), list(compress(raw, may))
    sizes = np.array([len(r) for r in raw], np.int64)
    n_win, start = table["n_win"].to_numpy(), table["start"].to_numpy()
    after = np.cumsum(sizes + 1)
    at = after - sizes - 1
    text = np.frombuffer(b"\xff".join([*raw, b"\xff"]), np.uint8)
    # Letters from two on, a one after each context; bytes hold all letters of UTF-8 and sort faster.
    letter = np.uint8 if np.count_nonzero(text >= 254) == len(raw) + 1 else np.uint16
    text = text.astype(letter) + letter(2)
    text[after - 1], text[-1] = 1, 0
    longest = int(sizes.max(initial=0)) + 1
    # Wholly sorted: the prefixes rely on the order of suffixes that share any length.
    sa = suffix_array(text, len(text))
    shared = permuted_prefixes(text, sa, longest + WINDOW, at, WINDOW) >= WINDOW
    repeats = shared.copy()
    repeats[sa[:-1][shared[sa[1:]]]] = True
    edges = np.zeros(len(text), np.int8)
    edges[at], edges[at + n_win] = 1, -1
    repeats &= np.cumsum(edges, dtype=np.int8).view(bool)
    edge = np.diff(np.r_[0, repeats.astype(np.int8), 0])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(at, lo, "right") - 1
    anchor, context, n = (table[c].to_numpy() for c in ("anchor", "context", "n"))
    lead = np.r_[True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
    lo, hi, own = lo[lead[own]], hi[lead[own]], own[lead[own]]
    shift = np.where(n == 1, start, 0)[own] - at[own]
    named = table.select(["id", "tk", "n", "anchor", "context"]).take(pa.array(own))
    return pa.table({"id": named["id"], "tk": named["tk"], "n": named["n"], "lo": pa.array(lo + shift), "hi": pa.array(hi + shift), "anchor": named["anchor"], "context": named["context"]})


def covered(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Byte runs covered by windows that begin in the spans."""
    runs: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        end = min(size, hi - 1 + WINDOW)
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([lo, end])
    return [(a, b) for a, b in runs]


def kept_batches(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text, spans in zip(batch.column(1), batch.column(2)):
            buffer = text.as_buffer()
            raw = memoryview(buffer) if buffer is not None else memoryview(b"")
            runs = covered(spans.as_py() or [], len(raw))
            digest, at, left = hashlib.sha256(), 0, []
            for a, b in [*runs, (len(raw), len(raw))]:
                digest.update(raw[at:a])
                if texts:
                    left.append(bytes(raw[at:a]))
                at = b
            for c, v in zip(cols, (len(raw), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), b"".join(left))):
                c.append(v)
        out = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if texts:
            out.append(pa.array([x.decode("utf-8", "ignore") for x in cols[4]], pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(out, names)


def resolved(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Spans of rows whose key repeats."""
    return rows.join(keys, list(on), "left_semi").select("id", "tk", F.col("start").alias("lo"), (F.col("start") + F.col("n_win")).alias("hi"))


def single(name: str) -> Column:
    return F.first(name).alias(name)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with ``texts`` what is kept, as text.

    A kept text drops bytes of characters that a removed run cuts through.
    """
    source = bounded_batches(docs).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    anchors = cut(source.select("id", "tk", F.col("text").cast("binary")).mapInArrow(anchor_batches, ANCHOR_SCHEMA))
    # Written before the join, so that Spark can split the rows of a very common anchor.
    shared = cut(anchors.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    anchors = cut(anchors.join(shared, "anchor", "left_semi"))
    place = F.struct("id", "tk", "start")
    classes = cut(anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.first("n_win").alias("n_win"), F.min(place).alias("first"), F.max(place).alias("last")))
    hot = cut(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("anchor"))
    places = F.when(F.col("first") == F.col("last"), F.array("first")).otherwise(F.array("first", "last"))
    asked = classes.withColumn("at", F.explode(places)).select("at.*", "n_win", "n", "anchor", "context")
    total = classes.agg(F.sum(F.size(places) * (F.col("n_win") + WINDOW))).first()[0]
    spans = []
    if total:
        by_doc = asked.groupBy("id", "tk").agg(F.collect_list(F.struct("start", "n_win", "n", "anchor", "context")).alias("asked"))
        # The same left join as in the end, so that Spark reads one exchange of the texts twice.
        found = source.join(by_doc, ["id", "tk"], "left").select("id", "tk", F.col("text").cast("binary").alias("text"), "asked", "doc_id").mapInArrow(context_batches, PIECE_SCHEMA)
        shards = int(-(-total // SHARD_BYTES))
        classes_apart = None
        if hot.take(1):
            found = cut(found)
            of_hot = by_list(found, hot, ["anchor"], "left_semi").select(*PIECE_COLUMNS)
            pieces = cut(of_hot.mapInArrow(lambda b: piece_batches(b, PIECE), PIECE_SCHEMA))
            classes_apart = of_hot.where("n > 1")
            found = by_list(found, hot, ["anchor"], "left_anti").select(*PIECE_COLUMNS)
            merged = cut(pieces.groupBy("anchor", "context").agg(F.sum("n").alias("total"), *map(single, ("id", "tk", "start", "n_win", "bytes"))).withColumn("n", F.least("total", F.lit(2))).drop("total"))
            spans.append(resolved(pieces.where("n = 1"), merged.where("n > 1").select("anchor", "context"), "anchor", "context"))
            many = cut(merged.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
            left = merged.join(many, "anchor").select(*PIECE_COLUMNS, "kinds")
            found = found.union(left.where(F.col("kinds") <= HOT).drop("kinds"))
            windows = cut(left.where(F.col("kinds") > HOT).drop("kinds").mapInArrow(lambda b: piece_batches(b, 1), PIECE_SCHEMA).drop("bytes"))
            counted = windows.groupBy("anchor", "context").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "context")
            spans.append(resolved(windows.where("n = 1"), counted, "anchor", "context"))
        dealt = found.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        if classes_apart is not None:
            dealt = dealt.union(classes_apart.withColumn("shard", F.pmod(F.xxhash64("anchor", "context"), F.lit(shards))))
        decided = cut(dealt.groupBy("shard").applyInArrow(shard_spans, SPAN_SCHEMA))
        spans.append(decided.where("n = 1").select("id", "tk", "lo", "hi"))
        of_classes = decided.where("n > 1").select("anchor", "context", "lo", "hi")
        spans.append(anchors.join(of_classes, ["anchor", "context"]).select("id", "tk", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))
    every = anchors.select("id", "tk", F.col("start").alias("lo"), F.col("start").alias("hi")).where(F.lit(False))
    for s in spans:
        every = every.union(s)
    by_doc = every.groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    more = ", kept_text string" if texts else ""
    joined = source.join(by_doc, ["id", "tk"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(lambda b: kept_batches(b, texts), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + more)
