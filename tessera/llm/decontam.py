"""Benchmark passages in documents, found by spaced seeds that no accepted passage can lack.

A document holds an item if, on one diagonal, a stretch of at least 13 words (the item's length
if that is less) agrees in over four words of five, or if seven tenths of the item's words agree.

Seeds are fixed masks: a word under a 1 must agree, a word under a 0 may be any.  An accepted passage
of an item of MASKED_WORDS words or more always has a hit of one of MASKS: some part of 13 to 25 words
(or the item's 12) agrees in seven tenths, and every way to place the other words was tried
(``complete``; a test does so again).  Shorter items leave at most d words replaced, so one of d + 1
contiguous pieces, cut as evenly as can be, is whole, and pieces of one to three words are their seeds.
Around each hit the document is laid beside the item word by word and judged by the words that agree.

A benchmark of up to BLOCK_WORDS words, counted first, goes to the executors whole.  A larger one meets
the documents in a shuffled join of seed hashes, after a bitmap of fixed size has sorted out the seeds
of documents that no item has; nothing of it passes through the driver.

Edge cases: null items and items without a word are never found, an item of one to three words
only word for word; null texts hold nothing; rows with the same id and text give the same rows; several items with one id are told
apart by their words only, and the best row of an (doc_id, item_id) stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.scratch import bounded_batches, cut

MIN_RUN = 13
#: A mask's 1s are words that must agree; three masks of weight four have a hit in every accepted passage of MASKED_WORDS words and more.
MASKS = ("10111", "1001011", "100111")
MASKED_WORDS = 12
#: Seeds of shorter items.
PIECES = ("1", "11", "111")
BLOCK_WORDS = 1 << 18
FILTER_BITS = 22
#: Bits of the bitmap of a larger benchmark's seeds, in blocks of Spark's own size.
BITMAP_BITS, BITMAP_BLOCK = 26, 1 << 15
#: Hits of one document that are judged together, and hits and words of overlaps laid out at once.
TOGETHER = 512
LAID_OUT = 1 << 18


def complete(masks: tuple[str, ...], words: int, replaced: int) -> bool:
    """Whether some mask has a hit in ``words`` words, whichever ``replaced`` of them differ."""
    places = [sum(1 << (at + k) for k, c in enumerate(m) if c == "1") for m in masks for at in range(words - len(m) + 1)]
    lost = np.array(list(combinations(range(words), replaced)), np.int64).reshape(-1, replaced)
    lost, hit = (np.int64(1) << lost).sum(axis=1), np.zeros(math.comb(words, replaced), bool)
    for place in places:
        hit |= (lost & place) == 0
    return bool(hit.all())


def whole_words(n: int) -> int:
    """The least count of agreeing words that is seven tenths of ``n``."""
    return -(-7 * n // 10)


def seed_hashes(hashes: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray]]:
    """Each mask with the hash, at each place it fits, of the words under its 1s."""
    for mask in masks:
        n = max(0, len(hashes) - len(mask) + 1)
        g = np.zeros(n, tk.U64)
        for k, c in enumerate(mask):
            if c == "1":
                g = (g + hashes[k : k + n]) * tk.U64(tk.BASE)
        yield mask, tk.mix(g + tk.U64(int(mask, 2)))


def item_seeds(words: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[str, ...]]:
    """(seed, place among ``words``, item) of every seed of some items, and the masks they are of."""
    sizes = np.diff(ranges)
    placed: dict[str, np.ndarray] = {}
    for mask in MASKS:
        inner = np.where(sizes >= MASKED_WORDS, sizes - len(mask) + 1, 0)
        placed[mask] = np.repeat(ranges[:-1], inner) + within(inner)
    pieces = np.where((sizes > 0) & (sizes < MASKED_WORDS), sizes - -(-7 * sizes // 10) + 1, 0)
    k, of, n = within(pieces), np.maximum(np.repeat(pieces, pieces), 1), np.repeat(sizes, pieces)
    begin, width = np.repeat(ranges[:-1], pieces) + k * n // of, (k + 1) * n // of - k * n // of
    placed |= {mask: begin[width == len(mask)] for mask in PIECES}
    masks = tuple(m for m in (*MASKS, *PIECES) if len(placed[m]))
    seeds = [g[placed[m]] for m, g in seed_hashes(words, masks)]
    places = [placed[m] for m in masks]
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    return (np.concatenate(seeds) if seeds else np.zeros(0, tk.U64)), every, np.repeat(np.arange(len(sizes)), sizes)[every], masks


def laid_out(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to LAID_OUT at most (one larger row is a range of its own)."""
    sums, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + LAID_OUT, "right")))
        yield lo, hi
        lo = hi


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2... for each row, as many as its size says."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Block:
    """Some benchmark items: their words' hashes, one after another, and the seeds in them."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64)
        low = tk.LOWER[buf]
        starts, ends, self.ranges = tk.words(low, bounds, tk.ALNUM_LOWER)
        self.ids, self.words = np.array(ids, np.int64), tk.word_hashes(low, starts, ends)
        seeds, places, _, self.masks = item_seeds(self.words, self.ranges)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.ranges))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.seeds >> tk.U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def diagonals(self, hashes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place of the item's first word) of all hits that may count."""
        found = []
        doc = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
        for mask, g in seed_hashes(hashes, self.masks):
            at = np.flatnonzero(self.filter[(g >> tk.U64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.seeds, g[at], "left"), np.searchsorted(self.seeds, g[at], "right")
            at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            for a, b in laid_out(times):
                rows = np.repeat(at[a:b], times[a:b])
                place = self.places[np.repeat(lo[a:b], times[a:b]) + within(times[a:b])]
                item = self.item[place]
                hits = np.unique(np.c_[doc[rows], item, rows - ranges[doc[rows]] - (place - self.ranges[item])], axis=0)
                found.append(hits[self.may_count(hits, hashes, ranges)])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def may_count(self, hits: np.ndarray, hashes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Which diagonals the rule of ``judge`` accepts, all at once."""
        doc, item, first = hits.T
        size = self.ranges[item + 1] - self.ranges[item]
        lo = np.maximum(0, -first)
        n = np.minimum(size, ranges[doc + 1] - ranges[doc] - first) - lo
        out = np.zeros(len(hits), bool)
        for a, b in laid_out(n + 1):
            row, k = np.repeat(np.arange(b - a), n[a:b] + 1), within(n[a:b] + 1)
            begin = np.flatnonzero(k == 0)
            at = (self.ranges[item] + lo)[a:b][row] + k - 1
            own = (ranges[doc] + first + lo)[a:b][row] + k - 1
            agree = (self.words[at] == hashes[own]) & (k > 0)
            total = np.add.reduceat(agree.astype(np.int64), begin)
            out[a:b] = 10 * total >= 7 * size[a:b]
            # Sums of each overlap lie below all sums of those before it, so minima do not cross.
            sums = np.cumsum(np.where(k == 0, 0, np.where(agree, 1, -4)))
            sums -= sums[begin][row] + row * np.int64(10 * (int(n[a:b].max()) + 1))
            least = np.minimum(MIN_RUN, size[a:b])[row]
            end = np.flatnonzero(k >= least)
            good = sums[end] > np.minimum.accumulate(sums)[end - least[end]]
            out[a:b][row[end[good]]] = True
        return out

    def judge(self, own: np.ndarray, item: int, first: int) -> tuple[int, int, int] | None:
        """(first word, last word + 1, agreeing words) of the overlap on a diagonal, if it counts."""
        words = self.words[self.ranges[item] : self.ranges[item + 1]]
        lo, hi = max(0, -first), min(len(words), len(own) - first)
        agree = words[lo:hi] == own[first + lo : first + hi]
        total = int(agree.sum())
        sums, least = np.r_[0, np.cumsum(np.where(agree, 1, -4))], min(MIN_RUN, len(words))
        if 0 < least <= len(agree):
            # The best stretch of at least that many words: a score above 0 is over four words of five.
            low = np.minimum.accumulate(sums[: len(sums) - least])
            gain = sums[least:] - low
            end = int(gain.argmax()) + least
            if sums[end] > low[end - least]:
                start = int(sums[: end - least + 1].argmin())
                return first + lo + start, first + lo + end, int(agree[start:end].sum())
        if total >= whole_words(len(words)):
            where = np.flatnonzero(agree)
            return first + lo + int(where[0]), first + lo + int(where[-1]) + 1, total
        return None


def overlap_batches(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        best: dict[tuple, tuple] = {}
        for lo, _, buf, bounds in tk.parts(batch.column(1)):
            low = tk.LOWER[buf]
            starts, ends, ranges = tk.words(low, bounds, tk.ALNUM_LOWER)
            hashes = tk.word_hashes(low, starts, ends)
            for d, item, first in block.diagonals(hashes, ranges).tolist():
                if (got := block.judge(hashes[ranges[d] : ranges[d + 1]], item, first)) is not None:
                    key = (lo + d, int(block.ids[item]))
                    n = int(block.ranges[item + 1] - block.ranges[item])
                    best[key] = max(best.get(key, (0, 0, 0, 0)), (got[2], -got[0], got[1], n))
        rows = [(ids[d], i, -s, e, m, n) for (d, i), (m, s, e, n) in best.items()]
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_word", "end_word", "n_match", "item_words"])


SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, n_match bigint, item_words bigint"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))


def whole_block(benchmark: DataFrame) -> Block | None:
    """The benchmark as one block, if it has BLOCK_WORDS words at most by the lengths of its texts."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.floor(F.length("item") / 2) + 1)).first()[0] or 0) > BLOCK_WORDS:
        return None
    rows = items.collect()
    return Block([r[0] for r in rows], [r[1] for r in rows])


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words' hashes, each text's range among them), some rows at a time."""
    for lo, _, buf, bounds in tk.parts(column):
        low = tk.LOWER[buf]
        starts, ends, ranges = tk.words(low, bounds, tk.ALNUM_LOWER)
        yield lo, tk.word_hashes(low, starts, ends), ranges


def item_seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item_key, at) of every seed of items (item_key, item)."""
    for batch in batches:
        for lo, words, ranges in words_of(batch.column(1)):
            seeds, places, item, _ = item_seeds(words, ranges)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), batch.column(0).take(pa.array(lo + item)), pa.array(places - ranges[item])], ["seed", "item_key", "item_at"])


def doc_seed_batches(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(seed, doc_key, at) of the seeds of documents (doc_key, text) that the bitmap has."""
    for batch in batches:
        for lo, words, ranges in words_of(batch.column(1)):
            doc = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
            for mask, g in seed_hashes(words, (*MASKS, *PIECES)):
                bit = (g >> tk.U64(64 - BITMAP_BITS)).astype(np.int64)
                at = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                at = at[doc[at] == doc[at + len(mask) - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), batch.column(0).take(pa.array(lo + doc[at])), pa.array(at - ranges[doc[at]])], ["seed", "doc_key", "doc_at"])


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for the upper BITMAP_BITS of each seed: blocks are filled on the executors, and there are never more than fit in 2 ** BITMAP_BITS bits."""
    bit = seeds.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).alias("bit"))
    blocks = bit.groupBy(F.floor(F.col("bit") / BITMAP_BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BLOCK).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in blocks.collect():
        out[row.block * BITMAP_BLOCK // 8 : (row.block + 1) * BITMAP_BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def judged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_key, doc_id, text, items of (item_id, item)) to (doc_key, and the columns of SCHEMA)."""
    for batch in batches:
        for k in range(batch.num_rows):
            items = batch.column(3)[k].as_py()
            one = pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)], ["doc_id", "text"])
            found = next(overlap_batches(iter([one]), Block([x["item_id"] for x in items], [x["item"] for x in items])))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * found.num_rows, pa.string()), *found.columns], ["doc_key", *found.schema.names])


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_doc_key``: rows that agree in id and text share it, and their results too."""
    return docs.withColumn("_doc_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary")))


def joined_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_key and the columns of SCHEMA, by a shuffled join of seed hashes; ``docs`` has _doc_key.

    A seed that is frequent on both sides is a skewed partition, which Spark splits; what meets is told
    apart by (document, item) before texts are fetched, TOGETHER items of a document at a time.
    """
    spark = docs.sparkSession
    items = cut(_items(benchmark).withColumn("item_key", F.md5(F.concat_ws(":", "item_id", "item").cast("binary"))).dropDuplicates(["item_key"]))
    seeds = cut(items.select("item_key", "item").mapInArrow(item_seed_batches, "seed bigint, item_key string, item_at bigint"))
    bitmap = spark.sparkContext.broadcast(seed_bitmap(seeds))
    texts = docs.select(F.col("_doc_key").alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").dropDuplicates(["doc_key"])
    hits = texts.select("doc_key", "text").mapInArrow(lambda b: doc_seed_batches(b, bitmap.value), "seed bigint, doc_key string, doc_at bigint")
    pairs = cut(hits.join(seeds.select("seed", "item_key").distinct().hint("merge"), "seed").select("doc_key", "item_key").distinct())
    many = pairs.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("item_key"), F.ceil(F.col("n") / TOGETHER))
    grouped = pairs.join(many, "doc_key").withColumn("share", share).join(items, "item_key").groupBy("doc_key", "share").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    rows = grouped.select("doc_key", "items").join(texts, "doc_key").select("doc_key", "doc_id", "text", "items")
    found = rows.mapInArrow(judged_batches, f"doc_key string, {SCHEMA}")
    # Items with one id stand in several shares: the best row stays, as in one block.
    order = F.struct("n_match", (-F.col("start_word")).alias("s"), "end_word", "item_words")
    best = found.groupBy("doc_key", "doc_id", "item_id").agg(F.max(order).alias("b"))
    return best.select("doc_key", "doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.end_word", "b.n_match", "b.item_words")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: where (words, from 0), agreeing words, the item's words."""
    docs = bounded_batches(docs).select("doc_id", "text")
    if (block := whole_block(benchmark)) is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        return docs.mapInArrow(lambda b: overlap_batches(b, shared.value), SCHEMA)
    every = keyed(docs).select(F.col("_doc_key").alias("doc_key"))
    return every.join(joined_overlaps(keyed(docs), benchmark), "doc_key").drop("doc_key")


def keep_batches(batches: Iterator[pa.RecordBatch], block: Block, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(at)], ["doc_id", "text"])
        clean = np.ones(len(batch), bool)
        clean[next(overlap_batches(iter([rows]), block)).column(0).to_numpy()] = False
        yield batch.filter(pa.array(clean))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were."""
    at = bounded_batches(docs).columns.index("text")
    if (block := whole_block(benchmark)) is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        return docs.mapInArrow(lambda b: keep_batches(b, shared.value, at), docs.schema)
    held = joined_overlaps(keyed(docs.select("doc_id", "text")), benchmark).select(F.col("doc_key").alias("_doc_key")).distinct()
    return keyed(docs).join(held, "_doc_key", "left_anti").drop("_doc_key")
