"""How far the sources of a language stand apart in their use of terms.

DuckDB runs inside Spark's tasks.  Tasks over documents turn texts into counts with one SQL
statement for some megabytes at a time and merge what they have before it is dealt; hash shards by
lang and term then run SQL for the counts of kept terms, and again for partial sums over pairs of
sources.  Spark merges sums and ranks.

A term that neither source of a pair has, or only one of them, is never laid out: with p a source's
share of a term and z its share of an absent one, the sum over kept terms of ``|p - p'|`` is
``V |z - z'|``, plus ``|p - z'| - |z - z'|`` for each term of the first, the same for each of the
second, and ``|p - p'| - |p - z'| - |z - p'| + |z - z'|`` for each term of both.  Shards sum the
last over pairs, and the second per source, where shares of at least the greatest z of the lang
need no more than a count and a sum.  All arithmetic is on integers.

Edge cases: null lang, source and text are empty strings; every row counts as a document, so
repeated rows count again; an empty table gives no rows; a lang without kept terms has pairs of
value 0 and no terms; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches, cut, drop

#: A term is kept in a lang if that many of its documents have it.
LEAST_DOCS = 30
#: Ranks of the part ``term``.
TOP_TERMS = 50
#: Bytes of text that one statement turns into counts, and rows of counts that a task merges before it lets them go.
FLUSH_BYTES, MERGE_ROWS = 16 << 20, 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

TOKENS = f"""
    WITH d AS (SELECT row_number() OVER () AS row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM held),
    n AS (SELECT row, lang, source, term, count(*) AS n FROM d GROUP BY ALL)
    SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM n GROUP BY ALL
"""
MERGED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
KEPT = f"""
    WITH s AS ({MERGED})
    SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS opens
    FROM s QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {{least}}
"""
SHARES = """
    CREATE OR REPLACE TEMP TABLE shares AS
    SELECT lang, source, term, z, z_max,
           (1 + 1000000000::HUGEINT * (n + 5) // (total + 5::HUGEINT * vocabulary))::BIGINT AS p,
           (1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5) // (lang_total + 5::HUGEINT * vocabulary))::BIGINT AS q
    FROM held
"""
PARTIALS = """
    SELECT 'both' AS part, a.lang, a.source, b.source AS item, NULL::BIGINT AS low, count(*) AS terms,
           sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))::DECIMAL(38, 0) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
    UNION ALL
    SELECT 'one', lang, source, NULL, CASE WHEN p < z_max THEN p END AS low, count(*), sum(p)::DECIMAL(38, 0) FROM shares GROUP BY ALL
    UNION ALL
    SELECT 'term', lang, source, term, NULL, 1, (p - q)::DECIMAL(38, 0) FROM shares WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top}
"""

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
OPENS = pa.schema([*list(COUNTS)[:4], ("opens", pa.int64())])
SUMS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("low", pa.int64()), ("terms", pa.int64()), ("value", pa.decimal128(38, 0))])


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "preserve_insertion_order": False})


def _answer(con: duckdb.DuckDBPyConnection, held: pa.Table, sql: str, schema: pa.Schema, before: str | None = None) -> pa.Table:
    con.register("held", held)
    if before:
        con.execute(before)
    out = con.sql(sql).to_arrow_table().cast(schema)
    con.unregister("held")
    return out


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each source's terms in the texts of a task, merged as far as MERGE_ROWS reaches."""
    con, held, size, merged = _connection(), [], 0, COUNTS.empty_table()

    def flush() -> pa.Table:
        return _answer(con, pa.concat_tables([merged, _answer(con, pa.Table.from_batches(held), TOKENS, COUNTS)]), MERGED, COUNTS)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= FLUSH_BYTES:
            merged, held, size = flush(), [], 0
            if merged.num_rows >= MERGE_ROWS:
                yield from merged.to_batches()
                merged = COUNTS.empty_table()
    yield from (flush() if held else merged).to_batches()
    con.close()


def _shard(batches: Iterator[pa.RecordBatch], sql: str, schema: pa.Schema, before: str | None = None) -> Iterator[pa.RecordBatch]:
    """The answer of ``sql`` over all rows of a shard; beyond its memory limit DuckDB spills and cleans up after itself."""
    if held := [b for b in batches if b.num_rows]:
        con = _connection()
        yield from _answer(con, pa.Table.from_batches(held), sql, schema, before).to_batches()
        con.close()


def _spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint' if f.type == pa.int64() else 'decimal(38,0)'}" for f in schema)


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, opens) of the terms that at least ``least`` documents of their lang have; opens is 1 once a term."""
    read = bounded_batches(docs).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = read.mapInArrow(count_batches, _spark_schema(COUNTS))
    sql = KEPT.format(least=least)
    return counts.repartition("lang", "term").mapInArrow(lambda b: _shard(b, sql, OPENS), _spark_schema(OPENS))


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each (lang, source) that occurs, its total, its lang's total and vocabulary, its share z of an absent term, the lang's greatest z."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("opens").alias("vocabulary"))
    seen = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    found = seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "vocabulary"])
    found = cut(found.withColumn("z", F.expr("if(vocabulary > 0, 1 + 5000000000 div (total + 5 * vocabulary), 0)")))
    return found.join(found.groupBy("lang").agg(F.max("z").alias("z_max")), "lang")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by distance (``pair``), terms by excess over the lang (``term``)."""
    kept = cut(kept_counts(docs, least))
    groups = cut(_groups(docs, kept))
    sql = PARTIALS.format(top=top)
    shards = kept.join(groups, ["lang", "source"]).repartition("lang", "term")
    sums = cut(shards.mapInArrow(lambda b: _shard(b, sql, SUMS, SHARES), _spark_schema(SUMS)))
    drop(kept)

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"))
    pairs = groups.join(other, "lang").where("source <> item").withColumn("apart", F.expr("cast(abs(z - z_item) as decimal(38,0))"))
    base = pairs.select("lang", "source", "item", F.expr("cast(vocabulary * apart as decimal(38,0))").alias("value"))
    own = sums.where("part = 'one'").groupBy("lang", "source", "low").agg(F.sum("terms").alias("terms"), F.expr("cast(sum(value) as decimal(38,0))").alias("total_p"))
    one = own.join(pairs.select("lang", "source", "item", "z_item", "apart"), ["lang", "source"]).select(
        "lang", "source", "item", F.expr("cast(if(low is null, total_p - terms * cast(z_item as decimal(38,0)), terms * cast(abs(low - z_item) as decimal(38,0))) - terms * apart as decimal(38,0))").alias("value")
    )
    one = one.groupBy("lang", "source", "item").agg(F.expr("cast(sum(value) as decimal(38,0))").alias("value"))
    both = sums.where("part = 'both'").select("lang", "source", "item", "value")
    turned = one.union(both).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pair = base.union(one).union(both).union(turned).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    term = sums.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for df, part in ((pair, "pair"), (term, "term"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


DIVERGENCE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    shares AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM every),
    whole AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY lang, term),
    lang_shares AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
    pairs AS (SELECT g.lang, g.source, o.source AS item, coalesce(f.value, 0) AS value
              FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
              LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) f
              ON f.lang = g.lang AND f.source = g.source AND f.item = o.source),
    terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
               UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
