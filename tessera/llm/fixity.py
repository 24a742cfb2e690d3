"""Merkle trees over WARC records, and an audit of replicas.

Records stand in files (segments) of consecutive ids, in the order of their ids; each has an
offset and a length.  A leaf hashes a record with its offset and length; a node hashes the
FANOUT nodes below it, that is a range of offsets; above the segments the same goes on over
segment numbers up to one root.  Two replicas are compared from the root down: a level's nodes
are read only below nodes that differ, and records only in ranges that differ.

Verdicts: ok; moved (same bytes, other offset); corrupt (other bytes); missing or extra (in one
replica only).

Edge cases: null urls and payloads are empty; rows without an id stand in segments of their own
(by CRC of the url); records with one id are told apart by order of their bytes; two empty
replicas have no rows; columns beside page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.scratch import cut

FANOUT = 16
SEGMENT_IDS = 256
NO_ID_SEGMENTS = 64


def records(pages: DataFrame) -> DataFrame:
    """(page_id, occurrence, segment, idx, offset, length, record_sha256), one row for each record."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )
    segment = F.coalesce(F.floor(F.col("page_id") / F.lit(SEGMENT_IDS)), -1 - F.pmod(F.crc32(url.cast("binary")), F.lit(NO_ID_SEGMENTS)))
    rows = pages.select("page_id", segment.cast("long").alias("segment"), record.alias("record")).select(
        "page_id", "segment", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256")
    )
    order = Window.partitionBy("segment").orderBy("page_id", "record_sha256")
    return rows.select(
        "page_id",
        (F.row_number().over(Window.partitionBy("segment", "page_id").orderBy("record_sha256")) - 1).cast("long").alias("occurrence"),
        "segment",
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        "length",
        "record_sha256",
    )


def parents(nodes: DataFrame, place: str, *keys: str) -> DataFrame:
    """The level above: FANOUT neighbours' digests in order, hashed."""
    up = nodes.groupBy(*keys, F.floor(F.col(place) / F.lit(FANOUT)).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct(place, "digest"))).alias("below"))
    return up.select(*keys, F.col("up").alias(place), F.sha2(F.array_join(F.col("below.digest"), ""), 256).alias("digest"))


def tree(rows: DataFrame, depth: int, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels in segments, leaves first (segment, idx, digest), and levels over segments (segment, digest)."""
    leaf = F.sha2(F.concat_ws(":", "record_sha256", "offset", "length"), 256)
    inner = [rows.select("segment", "idx", leaf.alias("digest"))]
    for _ in range(depth):
        inner.append(cut(parents(inner[-1], "idx", "segment")))
    outer = [inner[-1].select("segment", "digest")]
    for _ in range(height):
        outer.append(cut(parents(outer[-1], "segment")))
    return inner, outer


def levels_for(n: int) -> int:
    """Levels above n nodes up to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def differing(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys of nodes that differ or stand in one tree only."""
    return a.withColumnRenamed("digest", "one").join(b.withColumnRenamed("digest", "two"), list(keys), "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(*keys)


def descend(one: list[DataFrame], two: list[DataFrame], place: str, found: DataFrame, *keys: str) -> DataFrame:
    """From differing nodes of the top level to those of the lowest."""
    for a, b in zip(reversed(one[:-1]), reversed(two[:-1])):
        up = cut(found.withColumnRenamed(place, "up"))
        under = lambda level: level.withColumn("up", F.floor(F.col(place) / F.lit(FANOUT)).cast("long")).join(up, [*keys, "up"], "left_semi").drop("up")  # noqa: E731, B023
        found = differing(under(a), under(b), *keys, place)
    return found


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """A verdict for every record of the first replica and every extra one of the second.

    Columns: page_id, occurrence, segment, record_offset, length, record_sha256 (the first
    replica's; the second's for extra records) and verdict.
    """
    a, b = cut(records(first)), cut(records(second))
    reach = a.union(b).agg(F.max("idx").alias("idx"), F.min("segment").alias("low"), F.max("segment").alias("high")).first()
    if reach["idx"] is None:
        return a.select("page_id", "occurrence", "segment", F.col("offset").alias("record_offset"), "length", "record_sha256", F.lit("ok").alias("verdict"))
    # Segment numbers may be negative, and floor division meets at -1 and 0: two roots then.
    depth, height = levels_for(reach["idx"] + 1), levels_for(max(abs(reach["low"]), abs(reach["high"])) + 1)
    inner_a, outer_a = tree(a, depth, height)
    inner_b, outer_b = tree(b, depth, height)
    top = differing(outer_a[-1], outer_b[-1], "segment")
    segments = descend(outer_a, outer_b, "segment", top)
    tops = segments.withColumn("idx", F.lit(0).cast("long"))
    ranges = descend(inner_a, inner_b, "idx", tops, "segment")
    bad = cut(ranges.select("segment", "idx"))
    suspects = lambda rows: rows.join(bad, ["segment", "idx"], "left_semi")
    key = [F.col("x.segment") == F.col("y.segment"), F.col("x.page_id").eqNullSafe(F.col("y.page_id")), F.col("x.occurrence") == F.col("y.occurrence")]
    # A record's twin may stand at an index that does not differ only if it is the same record: looked up in all of b.
    twins = suspects(a).alias("x").join(b.join(bad.select("segment").distinct(), "segment", "left_semi").alias("y"), key, "left")
    verdict = (
        F.when(F.col("y.segment").isNull(), "missing").when(F.col("x.record_sha256") != F.col("y.record_sha256"), "corrupt").when(F.col("x.offset") != F.col("y.offset"), "moved").otherwise("ok")
    )
    judged = twins.select("x.segment", "x.idx", verdict.alias("verdict"))
    known = a.join(judged, ["segment", "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("ok")))
    extra = suspects(b).alias("x").join(a.alias("y"), key, "left_anti").withColumn("verdict", F.lit("extra"))
    out = ["page_id", "occurrence", "segment", F.col("offset").alias("record_offset"), "length", "record_sha256", "verdict"]
    return known.select(*out).union(extra.select(*out))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults by rule: ids 5 modulo 97 lose their first character, ids 7 modulo 389 are gone."""
    html = F.when(F.pmod("page_id", F.lit(97)) == 5, F.substring("html", 2, 2**31 - 1)).otherwise(F.col("html"))
    return pages.where(F.coalesce(F.pmod("page_id", F.lit(389)) != 7, F.lit(True))).select("page_id", "url", html.alias("html"))
