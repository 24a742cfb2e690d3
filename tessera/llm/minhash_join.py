"""Near-duplicates by an inverted join over signature coordinates.

Each distinct shingle set gets a MinHash signature.  A document is posted under the values of
its PREFIX rarest coordinates: two signatures that agree in at least MATCHES of COORDS
coordinates share one of those.  In a posting list four bits of every coordinate, carried along,
bound the collisions from above; the collisions of what is left are counted on whole signatures,
and pairs of at least MATCHES are confirmed on the full shingle sets.  Pairs already in one group
are skipped.

Texts are read twice: once for signatures, and again those that still can link; only these are stored.

Chance: documents of similarity 0.8 agree in 25.6 of 32 coordinates on average; fewer than 13
have a probability of 2e-7, the chance to miss a link that stands just at the threshold.  Shingles
are told apart by 64-bit hashes.

Documents that share fewer than MATCHES of all their coordinates with any others are done.  No list
is expanded into all its pairs.  Every member is held against the list's pivot, and what
links is one group from then on.  A document of which too few shingles stand in any other group
is settled.  The rest gets other pivots as long as those join much.  What then is left meets in
cells of bounded size, planned by the distances to the pivot (the triangle inequality rules the
others out): their number grows with the square of the members of one star that similar texts
neither link to a pivot nor set apart, and with nothing else.

Edge cases: null, empty and blank texts have no shingles and link with nothing; rows that share
an id are one vertex, which links where any of their texts does; a null id comes back with a null
component and is kept; repeated rows come back as often as they came; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.components import components
from tessera.llm.scratch import bounded_batches, by_list, cut, drop

COORDS, MATCHES = 32, 13
PREFIX = COORDS - MATCHES + 1
THRESHOLD = 80
#: Documents with equal sums and size have equal sets, as far as a hash can tell.
SAME = ["sum1", "sum2", "n_shingles"]
#: Documents with equal digests (128 bits) have equal texts.
TEXT = ["text1", "text2"]
#: Members of a star that one task holds against each other, and their shingles, at most.
BLOCK, BLOCK_SHINGLES, BANDS = 512, 1 << 21, 20
#: Shingles of pivots that a worker keeps between rows.
CACHED_SHINGLES = 1 << 20
#: A further pivot is tried while the last ones linked at least one in so many open documents.
SETTLING = 8
#: Coordinate values posted most often, put last in every prefix; any number gives right results.
COMMON_VALUES = 1 << 16
COMMON_LOCAL = 8

_rng = np.random.Generator(np.random.PCG64(8))
XOR, MUL1, MUL2 = (_rng.integers(0, 2**63, (3, COORDS), dtype=np.int64).astype(tk.U64) * tk.U64(2)) | tk.U64(1)


def sets_of(buf: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, and its range among them."""
    low = tk.LOWER[buf]
    starts, ends, ranges = tk.words(low, bounds, tk.NOT_BLANK)
    all_of, at = tk.shingles(tk.word_hashes(low, starts, ends), ranges, k)
    sets = [np.unique(all_of[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
    return np.concatenate([np.zeros(0, tk.U64), *sets]), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, COORDS) least hashes, 32 bits each; zeros for an empty set."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, COORDS), np.uint32)
    if not len(some):
        return out
    for c in range(COORDS):
        x = (values ^ XOR[c]) * MUL1[c]
        x ^= x >> tk.U64(29)
        x *= MUL2[c]
        out[some, c] = np.minimum.reduceat((x >> tk.U64(32)).astype(np.uint32), at[some])
    return out


def sketches(sig: np.ndarray) -> list[np.ndarray]:
    """Four bits of each coordinate, sixteen coordinates to a long."""
    nibbles = (sig & np.uint32(15)).astype(tk.U64)
    shifts = (np.arange(16) * 4).astype(tk.U64)
    return [np.bitwise_or.reduce(nibbles[:, k : k + 16] << shifts, axis=1).view(np.int64) for k in (0, 16)]


def signature_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, bounds in tk.parts(batch.column(1)):
            values, at = sets_of(buf, bounds, k)
            sizes = np.diff(at)
            n = hi - lo
            sig = signatures(values, at)
            digests = b"".join(hashlib.blake2b(memoryview(buf[a:b]), digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist()))
            text = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(sizes, pa.int64()), *map(pa.array, sums(values, at)), pa.array([x.tobytes() for x in sig], pa.binary()), *map(pa.array, sketches(sig)), *(pa.array(x) for x in text.T)],
                ["doc_id", "n_shingles", "sum1", "sum2", "sig", "sk1", "sk2", *TEXT],
            )


def sums(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of each set's hashes."""
    some = np.flatnonzero(np.diff(at))
    sum1, sum2 = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
    if len(some):
        sum1[some] = np.add.reduceat(values, at[some]).view(np.int64)
        sum2[some] = np.bitwise_xor.reduceat(tk.mix(values), at[some]).view(np.int64)
    return sum1, sum2


def text_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, sums, size, signature, packed text)."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for lo, hi, buf, bounds in tk.parts(batch.column(1)):
            values, at = sets_of(buf, bounds, k)
            packed = [packer.compress(memoryview(buf[a:b])) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, sums(values, at)), pa.array(np.diff(at)), pa.array([x.tobytes() for x in signatures(values, at)], pa.binary()), pa.array(packed, pa.binary())], ["id", *SAME, "sig", "packed"])


def coordinates(sig: pa.Array) -> np.ndarray:
    """(rows, COORDS) values."""
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(-1, COORDS)


def values_of(sig: pa.Array) -> np.ndarray:
    """(rows, COORDS) longs: the coordinate above, its value below."""
    return (np.arange(COORDS, dtype=np.int64) << 32) | coordinates(sig)


def common_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinate values that stand at least COMMON_LOCAL times in the partition."""
    held, room = [], 0
    totals: dict[int, int] = {}

    def add() -> None:
        got, counts = np.unique(np.concatenate(held), return_counts=True)
        for v, c in zip(got[counts >= COMMON_LOCAL].tolist(), counts[counts >= COMMON_LOCAL].tolist()):
            totals[v] = totals.get(v, 0) + c

    for batch in batches:
        held.append(values_of(batch.column(0)).ravel())
        room += len(held[-1])
        if room > 2_000_000:
            add()
            held, room = [], 0
    if held:
        add()
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["value", "n"])


def posting_batches(batches: Iterator[pa.RecordBatch], common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    known, counts = common
    for batch in batches:
        values = values_of(batch.column(1))
        order = tk.mix(values.ravel().astype(tk.U64)) >> tk.U64(24)
        if len(known):
            at = np.minimum(np.searchsorted(known, values.ravel()), len(known) - 1)
            order += np.where(known[at] == values.ravel(), counts[at], 0).astype(tk.U64) << tk.U64(40)
        first = np.argsort(order.reshape(values.shape), axis=1)[:, :PREFIX]
        chosen = np.take_along_axis(values, first, axis=1).ravel()
        rows = pa.array(np.repeat(np.arange(len(values)), PREFIX))
        yield pa.RecordBatch.from_arrays([pa.array(chosen), *(batch.column(c).take(rows) for c in (0, 2, 3))], ["value", "id", "sk1", "sk2"])


def set_rows(opener: zstandard.ZstdDecompressor, packed: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of packed texts: all hashes, and each text's range among them."""
    texts = [opener.decompress(x.as_py()) for x in packed]
    values, at = [np.zeros(0, tk.U64)], [np.zeros(1, np.int64)]
    for _, _, buf, bounds in tk.parts(pa.array(texts, pa.binary())):
        some, ranges = sets_of(buf, bounds, k)
        values.append(some)
        at.append(ranges[1:] + at[-1][-1])
    return np.concatenate(values), np.concatenate(at)


def one_set(opener: zstandard.ZstdDecompressor, packed: bytes, k: int) -> np.ndarray:
    buf = np.frombuffer(opener.decompress(packed), np.uint8)
    return sets_of(buf, np.array([0, len(buf)], np.int64), k)[0]


def copy_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, id, sums, size, left, right): the rows whose full sets are equal."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        keep = [a.as_py() == b.as_py() or np.array_equal(one_set(opener, a.as_py(), k), one_set(opener, b.as_py(), k)) for a, b in zip(batch.column(5), batch.column(6))]
        yield pa.RecordBatch.from_arrays(batch.columns[:5], ["doc_id", "id", *SAME]).filter(pa.array(keep, pa.bool_()))


def measure_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(a, b, their signatures and packed texts) -> (a, b, collisions, distance) where collisions suffice."""
    opener = zstandard.ZstdDecompressor()
    sets: dict[bytes, np.ndarray] = {}
    for batch in batches:
        met = (coordinates(batch.column(2)) == coordinates(batch.column(3))).sum(axis=1)
        rows = np.flatnonzero(met >= MATCHES)
        distance = np.zeros(len(rows))
        both = np.zeros((len(rows), 3), np.int64)
        for j, i in enumerate(rows.tolist()):
            left, right = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
            if left not in sets:
                if sum(map(len, sets.values())) > CACHED_SHINGLES:
                    sets.clear()
                sets[left] = one_set(opener, left, k)
            x, y = sets[left], one_set(opener, right, k)
            n = len(np.intersect1d(x, y, assume_unique=True))
            both[j] = n, len(x), len(y)
            distance[j] = 1 - n / (len(x) + len(y) - n)
        take = pa.array(rows)
        cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(met[rows]), *(pa.array(c) for c in both.T), pa.array(distance)]
        yield pa.RecordBatch.from_arrays(cols, ["a", "b", "met", "both", "n_a", "n_b", "distance"])


def shingle_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, g, packed) -> one row for each shingle, told by 32 bits: two that meet by chance only keep a document open."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, len(batch), 64):
            part = batch.slice(lo, 64)
            values, at = set_rows(opener, part.column(2), k)
            rows = pa.array(np.repeat(np.arange(len(part)), np.diff(at)))
            yield pa.RecordBatch.from_arrays([pa.array((values >> tk.U64(32)).astype(np.uint32).view(np.int32)), *(part.column(c).take(rows) for c in range(2))], ["hash", "id", "g"])


def cell_links(table: pa.Table, k: int, threshold: int) -> pa.Table:
    """Links between different groups among a cell's members, by collisions and then full sets."""
    table = table.combine_chunks().sort_by([("p", "ascending"), ("side", "ascending"), ("id", "ascending")])
    ids, star, side = (table[c].to_numpy() for c in ("id", "p", "side"))
    _, group = np.unique(table["g"].to_numpy(), return_inverse=True)
    sig = coordinates(table["sig"].combine_chunks())
    values, at = set_rows(zstandard.ZstdDecompressor(), table["packed"].combine_chunks(), k)
    sizes = np.diff(at)
    vocabulary, place = np.unique(values, return_inverse=True)
    present = np.zeros(len(vocabulary), bool)
    found: list[tuple[int, int]] = []
    begin = np.flatnonzero(np.r_[True, star[1:] != star[:-1]])
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)]):
        first_right = lo + int(np.searchsorted(side[lo:hi], 2))
        lefts = range(lo, first_right) if first_right < hi else range(lo, hi)
        for i in lefts:
            other = np.arange(first_right, hi) if first_right < hi else np.arange(i + 1, hi)
            # Pairs already in one group are skipped, groups that met in this cell included.
            other = other[group[other] != group[i]]
            other = other[100 * np.minimum(sizes[other], sizes[i]) >= threshold * np.maximum(sizes[other], sizes[i])]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= MATCHES]
            if not len(other):
                continue
            present[place[at[i] : at[i + 1]]] = True
            both = np.array([np.count_nonzero(present[place[at[j] : at[j + 1]]]) for j in other.tolist()], np.int64)
            present[place[at[i] : at[i + 1]]] = False
            for j in other[100 * both >= threshold * (sizes[i] + sizes[other] - both)].tolist():
                if group[j] != group[i]:
                    found.append((int(ids[i]), int(ids[j])))
                    group[group == group[j]] = group[i]
    cols = list(zip(*found)) or [(), ()]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})


def agreeing(a: str, b: str) -> F.Column:
    """Coordinates whose four bits agree: no less than the true collisions."""

    def same(x: str) -> F.Column:
        d = F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))
        for by in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, by))
        return F.lit(16) - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return same("sk1") + same("sk2")


def numbered(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def fetched(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, sums, size, signature, packed text) of some documents, each set once, read from ``docs`` again: only these texts are stored."""
    asked = by_list(numbered(docs).withColumnRenamed("doc_id", "id"), ids, ["id"], "left_semi").select("id", "text")
    rows = cut(asked.mapInArrow(lambda x: text_batches(x, k), "id bigint, sum1 bigint, sum2 bigint, n_shingles bigint, sig binary, packed binary").where("n_shingles > 0"))
    on = ["id", *SAME]
    again = cut(rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").select(*on))
    if again.isEmpty():
        return rows
    # Rows that repeat are few as a rule, and texts are wide: only such rows are shuffled.
    out = cut(by_list(rows, again, on, "left_anti").union(by_list(rows, again, on, "left_semi").dropDuplicates(on)))
    drop(rows, again)
    return out


def copies_of(docs: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(doc_id, id, sums, size) of documents whose set equals that of ``id``, a lesser such document.

    Equal texts are told by their digests; of each other text with equal sums one is compared in full.
    """
    classes = cut(known.groupBy(*SAME).agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("last")).where("root <> last").drop("last"))
    rows = cut(by_list(known.select("doc_id", *SAME, *TEXT), classes, SAME, "inner"))
    kinds = cut(rows.groupBy(*SAME, *TEXT).agg(F.min("doc_id").alias("id"), F.min("root").alias("root")))
    pairs = by_list(rows.drop("root"), kinds.drop("root"), [*SAME, *TEXT], "inner").where("doc_id <> id").select("doc_id", "id", *SAME)
    other = cut(kinds.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("id"), *SAME).distinct())
    if not other.isEmpty():
        texts = fetched(docs, cut(other.select(F.col("doc_id").alias("id")).union(other.select("id")).distinct()), k)
        left = texts.select(F.col("id").alias("doc_id"), *SAME, F.col("packed").alias("left"))
        right = texts.select("id", *SAME, F.col("packed").alias("right"))
        both = other.join(left, ["doc_id", *SAME]).join(right, ["id", *SAME]).select("doc_id", "id", *SAME, "left", "right")
        pairs = pairs.union(both.mapInArrow(lambda x: copy_batches(x, k), "doc_id bigint, id bigint, sum1 bigint, sum2 bigint, n_shingles bigint"))
    out = cut(pairs.distinct())
    drop(classes, rows, kinds)
    return out


def posting_lists(unlike: DataFrame) -> DataFrame:
    """(value, id, sk1, sk2): lists of coordinate values under which different documents are posted."""
    table = unlike.select("sig").mapInArrow(common_batches, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    top = table.orderBy(F.desc("n"), "value").limit(COMMON_VALUES).toPandas().sort_values("value")
    common = (top["value"].to_numpy(np.int64), top["n"].clip(upper=(1 << 23)).to_numpy(np.int64))
    posted = unlike.select(F.col("doc_id").alias("id"), "sig", "sk1", "sk2").mapInArrow(lambda x: posting_batches(x, common), "value bigint, id bigint, sk1 bigint, sk2 bigint")
    # Written first: a join beside an exchange of its own can be split where a value is hot.
    met = cut(posted.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("value"))
    out = cut(by_list(posted, met, ["value"], "left_semi"))
    drop(met)
    return out


def coordinate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig) -> (value, id) for all coordinates."""
    for batch in batches:
        values = values_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), COORDS)))], ["value", "id"])


def screened(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Lists without the documents that share fewer than MATCHES of all their coordinates with any other."""
    ids = cut(lists.select("id").distinct())
    posted = cut(by_list(known.select(F.col("doc_id").alias("id"), "sig"), ids, ["id"], "left_semi").mapInArrow(coordinate_batches, "value bigint, id bigint"))
    met = cut(posted.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("value"))
    fit = cut(by_list(posted, met, ["value"], "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= MATCHES).select("id"))
    drop(posted, met, ids)
    several = lists.join(fit, "id", "left_semi")
    return cut(unsettled(cut(several.withColumn("g", F.col("id")))))


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the group of each id; an id in no link is its own group."""
    return rows.join(groups, "id", "left").withColumn("g", F.coalesce("g", "id"))


def unsettled(lists: DataFrame) -> DataFrame:
    """Lists (value, id, g, ...) that hold more than one group."""
    several = cut(lists.groupBy("value").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("value"))
    return lists.join(several, "value", "left_semi")


def able(lists: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Lists without the documents that no other group can hold enough shingles of.

    A link needs ``threshold`` hundredths of a document's own shingles in one document of another
    group, so at least as many must stand in other groups at all.
    """
    ids = cut(lists.select("id", "g").distinct())
    rows = cut(by_list(texts.select("id", "packed"), ids, ["id"], "inner").select("id", "g", "packed").mapInArrow(lambda x: shingle_batches(x, k), "hash int, id bigint, g bigint"))
    # Shingles of one group only, counted for their documents: the others need no second pass over all shingles.
    whose = rows.groupBy("hash").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("lo = hi")
    told = lambda x, n, h: F.struct(x.cast("bigint").alias("id"), n.cast("bigint").alias("n"), h.cast("int").alias("hash"))
    none, one = F.lit(None), F.lit(1)
    by = F.when(F.col("first") == F.col("last"), F.array(told(F.col("first"), F.col("n"), none))).when(F.col("n") == 2, F.array(told(F.col("first"), one, none), told(F.col("last"), one, none)))
    own = cut(whose.select(F.explode(F.coalesce(by, F.array(told(none, one, F.col("hash"))))).alias("x")).select("x.*").groupBy("id", "hash").agg(F.sum("n").alias("n")))
    several = cut(own.where("id is null").select("hash"))
    more = by_list(rows, several, ["hash"], "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    own = own.where("id is not null").select("id", "n").union(more).groupBy("id").agg(F.sum("n").alias("own"))
    sizes = texts.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("n_shingles").alias("all"), F.min("n_shingles").alias("n_shingles"))
    fit = cut(sizes.join(own, "id", "left").where(100 * (F.col("all") - F.coalesce("own", F.lit(0))) >= threshold * F.col("n_shingles")).select("id"))
    drop(rows, ids)
    return lists.join(fit, "id", "left_semi")


def stars(lists: DataFrame, turn: int) -> DataFrame:
    """(p, id, m): each list's members and its pivot, with the collisions that their sketches allow."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    pivots = cut(lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), "id", "g", "sk1", "sk2")).alias("x")).select("value", F.col("x.id").alias("p"), F.col("x.g").alias("pg"), F.col("x.sk1").alias("p_sk1"), F.col("x.sk2").alias("p_sk2")))
    met = lists.join(pivots, "value").where("id <> p").withColumn("m", agreeing("", "p_"))
    return cut(met.groupBy("p", "id").agg(F.max("pg").alias("pg"), F.max("g").alias("g"), F.max("m").alias("m")))


def measured(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Collisions and distance of the pairs (p, id)."""
    pairs = cut(pairs.select(F.col("p").alias("a"), F.col("id").alias("b")))
    one = only(texts, pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("sig").alias("b_sig"), F.col("packed").alias("right"))
    two = only(texts, pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("sig").alias("a_sig"), F.col("packed").alias("left"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", "a_sig", "b_sig", "left", "right")
    return cut(rows.mapInArrow(lambda x: measure_batches(x, k), "a bigint, b bigint, met bigint, both bigint, n_a bigint, n_b bigint, distance double"))


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids``, so that a join shuffles no others."""
    return by_list(texts, cut(ids.distinct()), ["id"], "left_semi")


def across(star: DataFrame, measures: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links between members of one star that stand in different groups, found cell by cell.

    Members are dealt into blocks of BLOCK by their distance to the pivot.  Distances of sets obey
    the triangle inequality, so only blocks whose distances differ by no more than a link's can
    hold a link; a member without a measured distance meets every block.  A row is a document in a
    cell, never a pair.
    """
    reach = int(-(-(100 - threshold) * BANDS // 100))
    far = measures.groupBy(F.col("a").alias("p"), F.col("b").alias("id")).agg(F.min("distance").alias("distance"))
    members = star.join(far, ["p", "id"], "left").join(texts.groupBy("id").agg(F.max("n_shingles").alias("size")), "id")
    mixed = star.groupBy("p").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("p")
    members = cut(members.join(mixed, "p", "left_semi").withColumn("band", F.coalesce(F.floor(F.col("distance") * BANDS).cast("int"), F.lit(-1))))
    parts = lambda n, w: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.ceil(F.col(w) / F.lit(BLOCK_SHINGLES)))
    whole = members.groupBy("p").agg(F.count("*").alias("of"), F.sum("size").alias("weight")).withColumn("parts", parts("of", "weight"))
    members = members.join(whole.select("p", (F.col("parts") > 1).alias("large")), "p").withColumn("band", F.when(F.col("large"), F.col("band")).otherwise(F.lit(0)))
    blocks = members.groupBy("p", "band", "large").agg(F.count("*").alias("of"), F.sum("size").alias("weight"))
    blocks = cut(blocks.withColumn("subs", parts("of", "weight").cast("long")).drop("of", "weight"))
    placed = members.drop("large").join(blocks, ["p", "band"]).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(5)), F.col("subs"))).select("p", "id", "g", "band", "sub", "large")
    each = blocks.where("large").select("p", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"))
    other = each.select("p", F.col("band").alias("band2"), F.col("sub").alias("sub2"))
    before = (F.col("band") < F.col("band2")) | ((F.col("band") == F.col("band2")) & (F.col("sub") <= F.col("sub2")))
    near = (F.col("band") < 0) | (F.col("band2") - F.col("band") <= reach)
    cells = cut(each.join(other, "p").where(before & near).withColumn("cell", F.xxhash64("band", "sub", "band2", "sub2", "p")))
    left = cells.select("p", "band", "sub", "cell", F.when((F.col("band") == F.col("band2")) & (F.col("sub") == F.col("sub2")), F.lit(0)).otherwise(F.lit(1)).alias("side"))
    right = cells.where("band <> band2 or sub <> sub2").select("p", F.col("band2").alias("band"), F.col("sub2").alias("sub"), "cell", F.lit(2).alias("side"))
    hot = placed.where("large").join(left.union(right), ["p", "band", "sub"]).select("p", "id", "g", "cell", "side")
    small = placed.where("not large").withColumn("cell", F.xxhash64("p")).withColumn("side", F.lit(0)).select("p", "id", "g", "cell", "side")
    held = hot.union(small).join(only(texts, members.select("id")).select("id", "sig", "packed"), "id")
    return cut(held.groupBy("cell").applyInArrow(lambda t: cell_links(t, k, threshold), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, text)."""
    schema = "doc_id bigint, n_shingles bigint, sum1 bigint, sum2 bigint, sig binary, sk1 bigint, sk2 bigint, text1 bigint, text2 bigint"
    signed = cut(numbered(docs).mapInArrow(lambda x: signature_batches(x, k), schema))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    copies = copies_of(docs, known, k)
    lists = screened(posting_lists(by_list(known, copies.drop("id"), ["doc_id", *SAME], "left_anti")), known)
    texts = fetched(docs, cut(lists.select("id").distinct()), k)
    edges, measures, turn = None, None, 0
    while True:
        star = stars(lists, turn)
        tested = measured(star.where(F.col("m") >= MATCHES).where("g <> pg"), texts, k)
        links = tested.where(100 * F.col("both") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")
        edges = links if edges is None else edges.union(links)
        measures = tested if measures is None else measures.union(tested)
        groups = cut(components(edges).withColumnRenamed("component", "g"))
        lists = unsettled(grouped(lists.drop("g"), groups))
        lists = cut(lists if turn else unsettled(able(cut(lists), texts, k, threshold)))
        seen = lists.agg(F.count_distinct("id").alias("open")).first()["open"]
        turn += 1
        # Another pivot pays while pivots still join a good part of what is open.
        if not seen or turn >= 2 and links.count() * SETTLING < seen:
            break
    first = groups.select(F.col("id").alias("a"), F.col("g").alias("b"))
    every = first.union(copies.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    if seen:
        every = every.union(across(stars(lists, turn - 1), measures, texts, k, threshold))
    final = components(every)
    out = (
        signed.select("doc_id", "n_shingles")
        .join(final.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    out = cut(out)
    drop(signed, texts)
    return out


def keep_one(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; rows without an id stay.

    Rows with the same id and text are one document, of which one row stays.  Rows with the same id
    and different texts are documents of their own: a vertex is then named by a hash below zero.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = cut(repeated)
    if repeated.isEmpty():
        gone = cut(near_duplicates(docs, k, threshold).where("not kept").select("doc_id"))
        return by_list(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)
    own = -1 - F.abs(F.xxhash64("doc_id", "text") % F.lit(1 << 62))
    marked = docs.join(repeated.withColumn("__again", F.lit(True)), "doc_id", "left")
    marked = cut(marked.withColumn("__vertex", F.when(F.col("__again"), own).otherwise(F.col("doc_id"))).drop("__again"))
    single = marked.where("__vertex < 0 and doc_id is not null").dropDuplicates(["__vertex"])
    marked = marked.where("__vertex >= 0 or __vertex is null").union(single)
    gone = near_duplicates(marked.select(F.col("__vertex").alias("doc_id"), "text"), k, threshold).where("not kept").select(F.col("doc_id").alias("__vertex"))
    return marked.join(gone, "__vertex", "left_anti").select(*docs.columns)
