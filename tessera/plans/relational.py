"""Scans, joins, aggregates, sets, rankings and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import candidates as cd
from tessera.operators import evaluation as ev
from tessera.operators import matrix as mx
from tessera.operators import ranking as rk
from tessera.operators.mentions import doc_entity_max_prior
from tessera.plans.registry import query
from tessera.plans.views import CANDIDATES, candidates
from tessera.sources.readers import json_value, parquet
from tessera.streaming.incremental import unprocessed


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT IN ('4-NOT SPECIFIED') AND o_orderkey BETWEEN 100 AND 9000")
def scan_filter_range(spark, d):
    rows = parquet(spark, d, "orders")
    return rows.where((F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").isin("4-NOT SPECIFIED") & F.col("o_orderkey").between(100, 9000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, s_suppkey, s_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def left_join_candidates(spark, d):
    return cd.left_join(parquet(spark, d, "part"), parquet(spark, d, "supplier"), "p_partkey", "s_suppkey").select("p_partkey", "p_name", "s_suppkey", "s_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_two_in(spark, d):
    customers = parquet(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    lines = parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return parquet(spark, d, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left_semi").join(lines, "o_orderkey", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_not_in(spark, d):
    # NOT EXISTS: hash partitioned at any size, where NOT IN would ask for a broadcast.
    return parquet(spark, d, "documents").select("doc_id", "lang").join(parquet(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_partkey = l.l_partkey)")
def incremental_anti(spark, d):
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return unprocessed(lines.select("l_orderkey", "l_partkey"), lines.where("l_returnflag = 'R'"), ["l_orderkey", "l_partkey"])


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_docs(spark, d):
    return parquet(spark, d, "documents").select("lang", "source").distinct()


@query("SELECT l_orderkey AS query_id, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def count_by_key(spark, d):
    return parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS entity, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY l_partkey")
def sum_counts(spark, d):
    return parquet(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.sum("l_quantity").cast("long").alias("total"))


@query("SELECT l_orderkey AS query_id, max(l_extendedprice) AS max_prior FROM lineitem GROUP BY l_orderkey")
def max_prior(spark, d):
    return parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.max("l_extendedprice").alias("max_prior"))


@query("SELECT o_custkey AS doc_id, l_partkey AS entity, max(l_extendedprice) AS max_prior FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey")
def doc_entity_max_prior_query(spark, d):
    mentions = parquet(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("mention"))
    priors = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("mention"), F.col("l_partkey").alias("entity"), F.col("l_extendedprice").alias("prior"))
    return doc_entity_max_prior(mentions, priors)


@query("SELECT l_orderkey AS query_id, l_partkey AS entity, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey), 6) AS ratio FROM lineitem GROUP BY l_orderkey, l_partkey")
def ratio_to_group(spark, d):
    rows = parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("entity")).agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("query_id"))
    return rows.select("query_id", "entity", F.round(F.when(total == 0, 1.0).otherwise(F.col("q") / total), 6).alias("ratio"))


@query(f"SELECT query_id, entity, prior, pos AS rank FROM {CANDIDATES} WHERE pos <= 3")
def topk_per_query(spark, d):
    return rk.top_k(candidates(spark, d), ["query_id"], [F.asc("pos")], 3).select("query_id", "entity", "prior", "rank")


@query(f"SELECT query_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM {CANDIDATES}) WHERE r = 1")
def argmax_per_query(spark, d):
    return rk.argmax(candidates(spark, d), "query_id", "score", "pos", "entity").select("query_id", "entity")


@query(f"""SELECT query_id, round(max(CASE WHEN r = 1 THEN score END), 9) AS top, round(exp(max(CASE WHEN r = 2 THEN score END) - max(CASE WHEN r = 1 THEN score END)), 6) AS gap1,
    round(exp(max(CASE WHEN r = 3 THEN score END) - max(CASE WHEN r = 1 THEN score END)), 6) AS gap2, round(exp(max(CASE WHEN r = 4 THEN score END) - max(CASE WHEN r = 1 THEN score END)), 6) AS gap3
    FROM (SELECT query_id, score / 1000 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM {CANDIDATES}) GROUP BY query_id""")
def score_gap_softmax(spark, d):
    out = rk.score_gaps(candidates(spark, d).withColumn("score", F.col("score") / 1000), "query_id", "score", "pos")
    return out.select("query_id", F.round("top", 9).alias("top"), *(F.round(c, 6).alias(c) for c in ("gap1", "gap2", "gap3")))


@query(f"SELECT query_id, pos, coalesce(round((prior - min(prior) OVER w) / nullif(max(prior) OVER w - min(prior) OVER w, 0), 6), 0) AS scaled FROM {CANDIDATES} WINDOW w AS (PARTITION BY query_id)")
def minmax_scale_group(spark, d):
    return rk.min_max(candidates(spark, d), ["query_id"], "prior", "scaled").select("query_id", "pos", F.round("scaled", 6).alias("scaled"))


@query(f"SELECT gold_rank, count(*) AS n FROM (SELECT label, rank() OVER (PARTITION BY query_id ORDER BY score DESC)::INTEGER AS gold_rank FROM {CANDIDATES}) WHERE label = 1 GROUP BY gold_rank")
def gold_rank_hist(spark, d):
    return rk.gold_rank(candidates(spark, d), "query_id", "score", "label").groupBy("gold_rank").agg(F.count("*").alias("n"))


@query(f"SELECT query_id, pos, sum(label) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM {CANDIDATES}")
def islands_from_labels(spark, d):
    return rk.islands(candidates(spark, d), ["query_id"], [F.asc("pos")], "label").select("query_id", "pos", F.col("island").cast("long").alias("island"))


@query(f"SELECT query_id, pos FROM (SELECT *, lag(supplier) OVER (PARTITION BY query_id ORDER BY pos) AS b FROM {CANDIDATES}) WHERE supplier IS DISTINCT FROM b")
def consecutive_dedup(spark, d):
    return rk.consecutive_first(candidates(spark, d), ["query_id"], [F.asc("pos")], "supplier").select("query_id", "pos")


@query(f"SELECT a.query_id, a.pos, a.prior, b.score FROM {CANDIDATES} a LEFT JOIN (SELECT query_id, pos, round(score, 6) AS score FROM {CANDIDATES} WHERE pos <= 4) b USING (query_id, pos)")
def block_join_features(spark, d):
    rows = candidates(spark, d)
    return mx.join_blocks(rows.select("query_id", "pos", "prior"), rows.where("pos <= 4").select("query_id", "pos", F.round("score", 6).alias("score")), ["query_id", "pos"])


@query(f"SELECT query_id, pos, round(CASE WHEN pos <= 3 THEN score ELSE score - 1000 END, 6) AS score FROM {CANDIDATES}")
def mask_non_topk(spark, d):
    rows = candidates(spark, d)
    return rk.masked(rows, rows.where("pos <= 3"), ["query_id", "pos"], "score").select("query_id", "pos", F.round("score", 6).alias("score"))


@query(f"""WITH o AS (SELECT query_id, max(CASE WHEN label = 1 THEN score END) AS g, max(CASE WHEN label = 0 THEN score END) AS b FROM {CANDIDATES} GROUP BY query_id),
    s AS (SELECT count(*) AS n, count(*) FILTER (g > b OR b IS NULL) AS c FROM o), t AS (SELECT count(*) AS total FROM orders)
    SELECT n, c AS n_correct, round(c / n, 6) AS p, round(c / total, 6) AS r, round(2 * (c / n) * (c / total) / (c / n + c / total), 6) AS f1 FROM s, t""")
def prf_eval(spark, d):
    total = parquet(spark, d, "orders").agg(F.count("*").alias("total"))
    return ev.precision_recall(candidates(spark, d), total).select("n", "n_correct", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query(f"""WITH r AS (SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS k FROM {CANDIDATES}),
    q AS (SELECT query_id, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2, max(CASE WHEN k = 3 THEN score END) AS s3, max(CASE WHEN label = 1 THEN score END) AS g FROM r GROUP BY query_id),
    f AS (SELECT *, g = s1 AND (s2 IS NULL OR s2 < s1) AS ok FROM q)
    SELECT count(*) AS n, count(*) FILTER (ok) AS top1, count(*) FILTER (g >= coalesce(s2, s1)) AS top2, count(*) FILTER (g >= coalesce(s3, s2, s1)) AS top3,
    round(avg(s1 - s2) FILTER (ok), 4) AS margin_right, round(avg(s1 - s2) FILTER (NOT ok), 4) AS margin_wrong FROM f""")
def top23_margin(spark, d):
    return ev.top_hits(candidates(spark, d)).select("n", "top1", "top2", "top3", F.round("margin_right", 4).alias("margin_right"), F.round("margin_wrong", 4).alias("margin_wrong"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (has = 1) AS in_dict, count(*) FILTER (first = 1) AS top_of_dict, round(100.0 * count(*) FILTER (has = 1) / count(*), 6) AS percent
    FROM (SELECT query_id, max(label) AS has, max(CASE WHEN pos = 1 THEN label END) AS first FROM {CANDIDATES} GROUP BY query_id)""")
def coverage_stats(spark, d):
    return ev.coverage(candidates(spark, d)).withColumn("percent", F.round("percent", 6))


@query("""WITH c AS (SELECT l_orderkey AS q, l_partkey AS e FROM lineitem), s AS (SELECT o_orderkey, o_orderkey % 2000 AS gold FROM orders)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE q = o_orderkey) THEN 'none' WHEN NOT EXISTS (SELECT 1 FROM c WHERE q = o_orderkey AND e = gold) THEN 'no_gold'
    WHEN gold NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 'no_article' ELSE 'valid' END AS status FROM s) GROUP BY status""")
def status_counts(spark, d):
    queries = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 2000).alias("gold"))
    rows = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("entity"))
    return cd.recall_status(queries, rows, parquet(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("entity"))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT query_id, entity, max(prior) FILTER (pos = last) AS prior FROM (SELECT *, max(pos) OVER (PARTITION BY query_id, entity) AS last FROM " + CANDIDATES + ") GROUP BY query_id, entity")
def last_prior(spark, d):
    return cd.last_prior(candidates(spark, d))


@query(f"""SELECT query_id, entity, pos FROM (SELECT c.*, g.entity AS gold, row_number() OVER (PARTITION BY c.query_id, c.entity ORDER BY c.pos) AS nth
    FROM {CANDIDATES} c JOIN (SELECT query_id, entity FROM {CANDIDATES} WHERE label = 1) g USING (query_id)) WHERE entity <> gold OR nth > 1""")
def remove_first_gold(spark, d):
    rows = candidates(spark, d)
    return cd.without_first(rows, rows.where("label = 1").select("query_id", "entity")).select("query_id", "entity", "pos")


@query("SELECT n_nationkey AS entity, coalesce(r_name, n_name) AS resolved FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey END AS k FROM nation) LEFT JOIN region ON k = r_regionkey")
def resolve_redirects(spark, d):
    redirects = parquet(spark, d, "nation").where("n_nationkey < 10").join(parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("target"))
    rows = parquet(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    return cd.resolve_redirects(rows, redirects).select(F.col("n_nationkey").alias("entity"), F.col("entity").alias("resolved"))


@query("""WITH dict AS (SELECT p_type AS mention, p_partkey AS entity, p_retailprice AS prior FROM part UNION ALL SELECT lower(p_type), p_partkey, p_retailprice FROM part WHERE p_size > 25),
    fb AS (SELECT upper(p_brand) AS mention, p_partkey AS entity, p_retailprice AS prior FROM part),
    m AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_brand ELSE lower(p_type) END AS mention FROM part),
    k AS (SELECT query_id, 0 AS way, CASE WHEN mention = upper(mention) THEN upper(mention[1]) || lower(mention[2:]) ELSE mention END AS form FROM m UNION ALL SELECT query_id, 1, mention FROM m UNION ALL SELECT query_id, 2, lower(mention) FROM m),
    f AS (SELECT query_id, way, entity, prior FROM k JOIN dict ON form = mention UNION ALL SELECT query_id, 3, entity, prior FROM m JOIN fb ON fb.mention = upper(m.mention)),
    s AS (SELECT query_id, way, count(*) AS n FROM f GROUP BY query_id, way),
    b AS (SELECT query_id, way FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN way < 2 THEN 0 ELSE way END, n DESC, way) AS r FROM s) WHERE r = 1)
    SELECT query_id, way, count(*) AS n, round(sum(prior), 4) AS total FROM f JOIN b USING (query_id, way) GROUP BY query_id, way""")
def candidate_cascade(spark, d):
    # What a mention finds depends on its form only, so each form is looked up once.
    part = parquet(spark, d, "part")
    rows = part.select(F.col("p_type").alias("mention"), F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("prior"))
    dictionary = rows.union(part.where("p_size > 25").select(F.lower("p_type"), "p_partkey", "p_retailprice"))
    fallback = part.select(F.upper("p_brand").alias("mention"), F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("prior"))
    form = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.lower("p_type"))
    mentions = part.select(F.col("p_partkey").alias("query_id"), form.alias("mention"))
    forms = mentions.select(F.col("mention").alias("query_id"), "mention").distinct()
    found = cd.cascade(forms, dictionary, fallback).groupBy("query_id", "way").agg(F.count("*").alias("n"), F.round(F.sum("prior"), 4).alias("total"))
    return mentions.join(found.withColumnRenamed("query_id", "mention"), "mention").select("query_id", "way", "n", "total")


@query("SELECT l_partkey AS entity, 'A' AS block FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, 'R' FROM lineitem WHERE l_returnflag = 'R'")
def union_blocks(spark, d):
    part = lambda f: parquet(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("entity"), F.lit(f).alias("block"))
    return part("A").unionByName(part("R"))


@query("SELECT DISTINCT l_orderkey AS entity FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, d):
    part = lambda f: parquet(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("entity")).distinct()
    return part("A").join(part("R"), "entity", "left_anti")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey LIMIT 50")
def limit_global(spark, d):
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey").limit(50)


@query(f"""WITH x AS (SELECT query_id, label, coalesce((prior - min(prior) OVER w) / nullif(max(prior) OVER w - min(prior) OVER w, 0), 0) AS a, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS b FROM {CANDIDATES} WINDOW w AS (PARTITION BY query_id)),
    o AS (SELECT query_id, max(CASE WHEN label = 1 THEN round(0.3 * a + 0.7 * b, 9) END) AS g, max(CASE WHEN label = 0 THEN round(0.3 * a + 0.7 * b, 9) END) AS h FROM x GROUP BY query_id)
    SELECT count(*) AS n, count(*) FILTER (g > h OR h IS NULL) AS n_correct, round(count(*) FILTER (g > h OR h IS NULL) / count(*), 6) AS accuracy FROM o""")
def linear_blend(spark, d):
    return ev.linear_blend(candidates(spark, d), "prior", "score", 0.3).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH o AS (SELECT query_id, max(CASE WHEN label = 1 THEN score END) AS g, max(CASE WHEN label = 0 THEN score END) AS b FROM {CANDIDATES} GROUP BY query_id)
    SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (NOT (g > b OR b IS NULL)) AS errors FROM o JOIN orders ON query_id = o_orderkey GROUP BY o_custkey""")
def errors_by_document(spark, d):
    docs = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    return ev.errors_by_document(candidates(spark, d).join(docs, "query_id"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return json_value(parquet(spark, d, "events").select("event_id", "event_type", "props"), "props", "struct<k:bigint>", '{"k": null}').select("event_id", "event_type", F.col("props.k").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_retailprice <> 0 AND p_size > 25 THEN p_retailprice ELSE p_size::DOUBLE END AS value FROM part")
def coalesce_zero(spark, d):
    rows = parquet(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(0.0).alias("value"))
    return mx.coalesce_zero(rows, "size", "value").select("p_partkey", "value")


@query("SELECT p_partkey, 1.0::DOUBLE AS bias, p_size::DOUBLE AS a, p_retailprice AS b, p_size::DOUBLE * p_size AS a_x_a, round(p_size * p_retailprice, 4) AS a_x_b, round(p_retailprice * p_retailprice, 4) AS b_x_b FROM part")
def polynomial_features(spark, d):
    rows = parquet(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return mx.quadratic(rows, ["a", "b"]).withColumn("a_x_b", F.round("a_x_b", 4)).withColumn("b_x_b", F.round("b_x_b", 4))
