"""Variant spellings: words one inserted, deleted or replaced letter apart, and the form each goes back to.

Words are counted in the JVM.  NumPy makes the deletion keys of many words at once: the hash of a
word without its i-th letter is the polynomial hash of its prefix plus that of its suffix, each read
from running sums, so the keys of a word cost one step a letter and no string is built.  Spark deals
keys by their upper bits and sorts them; a pass over the sorted keys keeps those that two words
share, and these alone are checked on the strings.

Two words that share a deletion at the same place differ by one replaced letter; a word that equals
another's deletion is one letter shorter.  A deletion inside a run of one letter counts at the run's
first place, so that every near pair is met once and near words can be counted without listing pairs.
Words that share a deletion differ in one letter of an alphabet of about 90, which bounds each group.

Edge cases: a null text has no words and a null doc_id counts as an empty string; repeated rows count
again; ties go to the smaller word in code-point order; an empty table gives no rows; other columns
are not read; a word may be as long as a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches, cut, drop
from tessera.llm.textkit import BASE, U64, mix, powers

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One in so many runs of letters loses a letter, by a checksum of its document and itself.
LOSS = 199
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form has at least so many times the count of its variant.
DOMINANCE = 5
#: Letters whose keys are worked out at once, and upper bits that deal keys to partitions.
PART_LETTERS, RADIX_BITS = 1 << 18, 16


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters of all texts, some with a letter lost, that are long and frequent enough.

    Runs below LEAST_LETTERS cannot give a word, so the pattern leaves them out.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate("text", UPPER, UPPER.lower()).alias("text"))
    # explode_outer: explode would have Spark test the array before it makes it, and so run the pattern again.
    runs = texts.select("id", F.explode_outer(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LEAST_LETTERS},}})"), F.lit(1))).alias("run"))
    lost = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    word = F.expr(f"if(h % {LOSS} = 0, concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)), run)")
    counts = lost.where("run is not null").select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, word's number) of each deletion of each word, and with place -1 of each whole word."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(U64)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    power, inverse = powers(len(letters) + 2)
    sums = np.zeros(len(letters) + 1, U64)
    np.cumsum(mix(letters + U64(1)) * inverse[: len(letters)], out=sums[1:])
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(letters))
    prefix = (sums[at] - sums[starts[owner]]) * power[starts[owner]]
    suffix = (sums[ends[owner]] - sums[at + 1]) * power[starts[owner] + 1]
    whole = (sums[ends] - sums[starts]) * power[starts]
    keys = np.concatenate([mix(whole + lengths.astype(U64) * U64(BASE)), mix(prefix + suffix + (lengths[owner] - 1).astype(U64) * U64(BASE))])
    return keys.view(np.int64), np.concatenate([np.full(len(texts), -1), at - starts[owner]]).astype(np.int32), np.concatenate([np.arange(len(texts)), owner])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        bound = np.cumsum([len(t) for t in texts]) // PART_LETTERS
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bound)) + 1):
            if len(part):
                keys, places, owners = deletion_keys([texts[k] for k in part])
                made = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places), pa.array(ids[part][owners])], ["key", "at", "id"])
                yield from (made.slice(k, PART_LETTERS) for k in range(0, made.num_rows, PART_LETTERS))


def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another word has too; the last key of a batch waits for the next."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([*(held.to_batches() if held is not None else ()), batch]).combine_chunks()
        if not now.num_rows:
            continue
        keys, ids = now["key"].to_numpy(), now["id"].to_numpy()
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        held = now.slice(int(firsts[-1]))
        yield from _shared(now.slice(0, int(firsts[-1])), firsts[:-1], ids[: firsts[-1]])
    if held is not None and held.num_rows:
        yield from _shared(held, np.zeros(1, np.int64), held["id"].to_numpy())


def _shared(rows: pa.Table, firsts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(firsts):
        several = np.minimum.reduceat(ids, firsts) != np.maximum.reduceat(ids, firsts)
        mask = np.repeat(several, np.diff(np.r_[firsts, len(ids)]))
        yield from rows.filter(pa.array(mask)).to_batches()


def near_words(dictionary: DataFrame) -> DataFrame:
    """(id, n_near, form, form_n) of the words with a near one; ``dictionary`` has id, word, n and is read twice."""
    rows = "key bigint, at int, id bigint"
    keys = bounded_batches(dictionary.select("id", "word")).mapInArrow(key_batches, rows)
    dealt = keys.repartition(F.shiftright("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    met = dealt.mapInArrow(shared_batches, rows).join(dictionary, "id")
    rest = F.expr("if(at < 0, word, concat(substring(word, 1, at), substring(word, at + 2)))")
    first = F.expr("at = 0 or (at > 0 and substring(word, at, 1) <> substring(word, at + 1, 1))")
    met = met.select("id", "key", "at", rest.alias("rest"), first.alias("first"), F.struct((-F.col("n")).alias("minus"), "word").alias("own"))
    same_rest, same_place = Window.partitionBy("key", "rest"), Window.partitionBy("key", "rest", "at")
    ordered = same_place.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = met.select(
        "*",
        F.max(F.when(F.col("at") < 0, F.col("own"))).over(same_rest).alias("shorter"),
        F.count(F.when(F.col("first"), 1)).over(same_rest).alias("longer_ones"),
        F.min(F.when(F.col("first"), F.col("own"))).over(same_rest).alias("longer"),
        F.count(F.lit(1)).over(same_place).alias("there"),
        F.min("own").over(same_place).alias("best"),
        F.nth_value("own", 2).over(ordered).alias("next"),
    )
    replaced = F.when(F.col("own") == F.col("best"), F.col("next")).otherwise(F.col("best"))
    shorter = F.when(F.col("first"), F.col("shorter"))
    near = seen.select(
        "id",
        F.when(F.col("at") < 0, F.col("longer_ones")).otherwise(F.col("there") - 1 + shorter.isNotNull().cast("long")).alias("near"),
        F.when(F.col("at") < 0, F.col("longer")).otherwise(F.least(replaced, shorter)).alias("best"),
    )
    found = near.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("id", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): every chain followed to its end by pointer doubling.

    Counts grow by DOMINANCE at each step, so a chain has at most 27 steps, and there are six rounds at most.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        moved = Observation()
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = cut(step.observe(moved, F.count(F.when(F.col("moved"), 1)).alias("n")).drop("moved"))
        drop(now)
        now = after
        if not moved.get["n"]:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs``."""
    dictionary = cut(words(docs).withColumn("id", F.monotonically_increasing_id()))
    joined = dictionary.join(near_words(dictionary), "id", "left")
    enough = F.col("form_n") >= DOMINANCE * F.col("n")
    formed = cut(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")))
    drop(dictionary)
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


CRC_SQL = """
    crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)
"""
SPELLING_SQL = f"""
    WITH RECURSIVE {CRC_SQL.strip()},
    r AS (SELECT id, run, count(*) AS n FROM (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
          WHERE length(run) >= {LEAST_LETTERS} GROUP BY id, run),
    b AS (SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''),
            lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))) AS bytes FROM r),
    h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]))) AS h FROM b, crc),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT n, CASE WHEN h % {LOSS} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h)
          WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    d AS (SELECT word, n, place, left(word, place) || substr(word, place + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS place FROM w)),
    near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
             UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
             UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
    picked AS (SELECT word, n_near, top, (SELECT min(other) FROM near WHERE near.word = best.word AND near.n = best.top) AS other FROM best),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {DOMINANCE} * w.n THEN other END AS form, CASE WHEN top >= {DOMINANCE} * w.n THEN top END AS form_n
          FROM w LEFT JOIN picked USING (word)),
    chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, form, chain.root, n, n_near::BIGINT AS n_near, form_n
    FROM f JOIN chain USING (word) WHERE chain.root IN (SELECT word FROM f WHERE form IS NULL)
"""
