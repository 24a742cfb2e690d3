"""Byte-level BPE without regular expressions.

Pre-tokenisation turns each text into an array of code-point classes.  A class stands for a
transition function over eight states; functions compose, so the states of all places follow
from an associative scan over blocks, and with them the places where a piece begins.  Pieces
are sliced out of the bytes, equal ones are met once for each part of a batch, looked up in a
cache, and merged together where the cache misses.  Byte offsets of the tokens stay at hand,
so that ids decode to the exact bytes.

Edge cases: a null or empty text has no tokens (digests are those of the empty string); texts
of any length are whole; every row gives one row, repeated rows and null ids included; other
columns are not read.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import textkit as tk
from tessera.llm.scratch import bounded_batches

BLOCK = 256
CACHE_PIECES = 60_000
LONG_PIECE = 192

# Classes of code points; a first character of a text has FIRST added.
LETTER, NUMBER, OTHER, JOINED, LONE_BLANK, BLANK, SHORT_APOSTROPHE, LONG_APOSTROPHE, FIRST = range(9)
# States after a character.
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(maxsize=1)
def code_points() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER for each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for plane in range(0, 0x110000, 0x10000):
        everything = "".join(map(chr, range(plane, plane + 0x10000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
            for run in regex.finditer(pattern, everything):
                table[plane + run.start() : plane + run.end()] = kind
    return table


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(state, class) -> next state, and whether a piece begins there; index state * 16 + class."""
    step, begins = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: IN_BLANKS}
    for state in range(8):
        for cls in range(16):
            was, kind = (ENDED, cls - FIRST) if cls >= FIRST else (state, cls)
            if was == ONE_LEFT:
                step[state, cls] = ENDED
            elif was == TWO_LEFT:
                step[state, cls] = ONE_LEFT
            elif kind in (SHORT_APOSTROPHE, LONG_APOSTROPHE):
                joins = was in (IN_OTHER, AFTER_BLANK)
                step[state, cls] = IN_OTHER if joins else ONE_LEFT if kind == SHORT_APOSTROPHE else TWO_LEFT
                begins[state, cls] = not joins
            elif kind == JOINED:
                step[state, cls], begins[state, cls] = AFTER_BLANK, True
            elif kind == LONE_BLANK:
                step[state, cls], begins[state, cls] = ENDED, True
            else:
                step[state, cls] = runs[kind]
                begins[state, cls] = was != runs[kind] and not (was == AFTER_BLANK and kind != BLANK)
    return step.ravel(), begins.ravel()


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The class of each character, looking ahead at most two places within its text."""
    n = len(points)
    cls = code_points()[points]
    blank = cls == BLANK
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    ends_run = blank.copy()
    ends_run[:-1] &= ~blank[1:]
    ends_run &= ~last
    cls[ends_run] = LONE_BLANK
    cls[ends_run & (points == 0x20)] = JOINED
    marks = np.flatnonzero((points == 0x27) & ~last)
    if len(marks):
        one = points[marks + 1]
        cls[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT_APOSTROPHE
        room = marks[(marks + 2 < n) & ~last[np.minimum(marks + 1, n - 1)]]
        two = points[room + 1].astype(np.int64) * 0x110000 + points[np.minimum(room + 2, n - 1)]
        cls[room[np.isin(two, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]] = LONG_APOSTROPHE
    cls[firsts] += FIRST
    return cls


def piece_starts(cls: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each place: states by a scan of composed transition functions."""
    step, begins = machine()
    n = len(cls)
    lanes = -(-n // BLOCK)
    grid = np.full(lanes * BLOCK, FIRST + BLANK, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    for row in grid:
        whole = step.take((whole << 4) | row)
    # whole[s, lane]: the state after the block if s was before it.  Prefixes by doubling.
    reach = 1
    while reach < lanes:
        later = np.take_along_axis(whole[:, reach:], whole[:, :-reach], axis=0)
        whole = np.concatenate([whole[:, :reach], later], axis=1)
        reach *= 2
    state = np.empty(lanes, np.uint8)
    state[0] = ENDED
    state[1:] = whole[ENDED, :-1]
    out = np.empty((BLOCK, lanes), bool)
    for k, row in enumerate(grid):
        at = (state << 4) | row
        out[k] = begins.take(at)
        state = step.take(at)
    return out.T.ravel()[:n]


class Vocabulary:
    """Ranks of a rank file, with the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        found = array.array("q")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    found.extend((a << 20 | b, rank))
        keys, ranks = np.frombuffer(found, np.int64).reshape(-1, 2).T
        self.size = 1 << max(8, (2 * len(keys)).bit_length())
        self.keys, self.merged = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            got, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[got], self.merged[got] = keys[put], ranks[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) % self.size
        self.young: dict[bytes, tuple[str, bytes]] = {}
        self.old: dict[bytes, tuple[str, bytes]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(tk.U64) * tk.U64(tk.BASE)) >> tk.U64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; a large number where there is none."""
        keys, out = a << 20 | b, np.full(len(a), 1 << 40, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.merged[at[hit]]
            more = ~hit & (there >= 0)
            todo, at = todo[more], (at[more] + 1) % self.size
        return out

    def pair_rank(self, a: int, b: int) -> int | None:
        rank = int(self.pair_ranks(np.array([a], np.int64), np.array([b], np.int64))[0])
        return rank if rank < 1 << 40 else None

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of pairs and a linked list."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        whole = np.array(ids, np.int64)
        heap = [(r, k) for k, r in enumerate(self.pair_ranks(whole[:-1], whole[1:]).tolist()) if r < 1 << 40]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= len(ids) or self.pair_rank(ids[k], ids[j]) != rank:
                continue
            ids[k], ids[j] = rank, -1
            after[k] = after[j]
            if after[k] < len(ids):
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else len(ids)
                if left >= 0 and right < len(ids) and (r := self.pair_rank(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Many pieces side by side: each round does the best merge of every unfinished piece."""
        out: list[list[int]] = [[] for _ in pieces]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(len(ids), 1 << 40, np.int64)
        mates = np.flatnonzero(owner[:-1] == owner[1:])
        rank[mates] = self.pair_ranks(ids[mates], ids[mates + 1])
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat((rank << 22) | np.arange(len(ids)), starts)
            over = (best >> 22) >= 1 << 40
            ended = np.repeat(over, sizes)
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            spot = best[~over] & ((1 << 22) - 1)
            ids[spot] = best[~over] >> 22
            keep = ~ended
            keep[spot + 1] = False
            moved = np.cumsum(keep) - 1
            spot = moved[spot]
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for changed in (spot, spot - 1):
                changed = changed[changed >= 0]
                pair = changed[(changed + 1 < len(ids)) & (owner[np.minimum(changed + 1, len(ids) - 1)] == owner[changed])] if len(ids) else changed[:0]
                rank[changed] = 1 << 40
                rank[pair] = self.pair_ranks(ids[pair], ids[pair + 1])
        if done_ids:
            ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(pieces) + 1)).tolist()
            flat = ids[order].tolist()
            out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Put the pieces' ids, as text, and the bytes they decode to into the cache."""
        young, old, short = self.young, self.old, []

        def put(piece: bytes, ids: list[int]) -> None:
            back = b"".join([self.bytes_of[i] for i in ids])
            # One object for both where the round trip is exact, as it always should be.
            young[piece] = (" ".join([self.names[i] for i in ids]), piece if back == piece else back)

        for p in pieces:
            if (known := old.get(p)) is not None:
                young[p] = known
            elif (rank := self.ranks.get(p)) is not None:
                put(p, [rank])
            elif len(p) > LONG_PIECE:
                put(p, self.merge_long(p))
            else:
                short.append(p)
        for lo in range(0, len(short), 20_000):
            some = short[lo : lo + 20_000]
            for p, ids in zip(some, self.merge_many(some)):
                put(p, ids)

    def lookup(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        """Each piece's cache entry.  The cache has two generations: what is met again stays."""
        found = list(map(self.young.get, pieces))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            if len(self.young) > CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.learn({pieces[k] for k in missing})
            for k in missing:
                found[k] = self.young[pieces[k]]
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The pieces of some texts, and each text's range among them."""
    raw = buf.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum((points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1), out=place[1:])
    firsts = np.searchsorted(place, bounds)
    starts = place[:-1][piece_starts(classes(points, np.unique(firsts[:-1][firsts[:-1] < firsts[1:]])))]
    cuts = [*starts.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])], np.searchsorted(starts, bounds).tolist()


def encoded(column: pa.Array, vocab: Vocabulary) -> Iterator[list[tuple[str, bytes]]]:
    """For each text the cache entries of its pieces: ids as text, bytes."""
    for lo, hi, buf, bounds in tk.parts(column):
        if not len(buf):
            yield from ([] for _ in range(lo, hi))
            continue
        pieces, ranges = pieces_of(buf, bounds)
        found = vocab.lookup(pieces)
        for a, b in zip(ranges, ranges[1:]):
            yield found[a:b]


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        counts, ids, back = [], [], []
        for own in encoded(batch.column(1), vocab):
            line = " ".join([x[0] for x in own])
            counts.append(line.count(" ") + 1 if line else 0)
            ids.append(hashlib.sha256(line.encode("ascii")).hexdigest())
            back.append(hashlib.sha256(b"".join([x[1] for x in own])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_batches(batches: Iterator[pa.RecordBatch], path: str, text: int, offsets: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    lengths = np.array([len(b) for b in vocab.bytes_of], np.int64)
    for batch in batches:
        for lo, hi, _, _ in tk.parts(batch.column(text), 2 * tk.PART_BYTES):
            part = batch.slice(lo, hi - lo)
            ids = [np.array(" ".join([x[0] for x in own]).split(), np.int32) for own in encoded(part.column(text), vocab)]
            out = {"token_ids": pa.array(ids, pa.list_(pa.int32()))}
            if offsets:
                out["token_offsets"] = pa.array([np.cumsum(lengths[x]) - lengths[x] for x in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *out.values()], [*batch.schema.names, *out])


def text_batches(batches: Iterator[pa.RecordBatch], path: str, column: int) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        back = [b"".join(map(vocab.bytes_of.__getitem__, x or [])).decode("utf-8", "replace") for x in batch.column(column).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, "decoded"])


def _typed(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """``df`` with ``token_ids`` and, if asked for, ``token_offsets`` (each token's first byte in the text)."""
    df = df.drop("token_ids", "token_offsets")
    at = df.columns.index(text)
    more = ", token_offsets array<bigint>" if offsets else ""
    return bounded_batches(df).mapInArrow(lambda b: token_batches(b, path, at, offsets), f"{_typed(df)}, token_ids array<int>{more}")


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, the text of the ids."""
    df = df.drop("decoded")
    at = df.columns.index(ids)
    return bounded_batches(df).mapInArrow(lambda b: text_batches(b, path, at), f"{_typed(df)}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens, SHA-256 of the ids and of the bytes they decode to, for each row."""
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(lambda b: digest_batches(b, path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
