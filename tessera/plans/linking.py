"""Mention scans, candidate filters, token layers, keyphrases and error reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import candidates as cd
from tessera.operators import coherence as co
from tessera.operators import coreference as cr
from tessera.operators import evaluation as ev
from tessera.operators import lemmas as lm
from tessera.operators import matrix as mx
from tessera.operators import mentions as mn
from tessera.operators import tagger as tg
from tessera.operators import tokens as tk
from tessera.plans.registry import query
from tessera.plans.textual import COUNTS, LINKS, MENTION, SIZES, SPREAD, TF, docs
from tessera.plans.views import CANDIDATES, EDGES, GROUP, PLACED, candidates, edges, paired
from tessera.sources import readers
from tessera.sources.lookup import Lookup, write_indexed
from tessera.sources.readers import parquet
from tessera.sources.workspace import fresh_path, stored

#: Parts as mentions: some unlinked, some without annotation, four corpus parts.
MENTIONS = """(SELECT p_partkey AS id, p_brand AS doc_id, p_name AS surfaceform, CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_partkey % 7 = 0 THEN 'NIL' ELSE p_type END AS annotation,
    list_extract(['train', 'testa', 'testb', 'test'], p_partkey % 4 + 1) AS type FROM part)"""


def mentions(spark, d):
    k = F.col("p_partkey")
    note = F.when(k % 11 == 0, "none").when(k % 7 == 0, "NIL").otherwise(F.col("p_type"))
    kind = F.element_at(F.array(*map(F.lit, ("train", "testa", "testb", "test"))), (k % 4 + 1).cast("int"))
    return parquet(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("doc_id"), F.col("p_name").alias("surfaceform"), note.alias("annotation"), kind.alias("type"))


@query(f"SELECT id, doc_id, surfaceform, annotation FROM {MENTIONS} WHERE type = 'testa' AND annotation NOT IN ('none', 'NIL') AND id BETWEEN 10 AND 150")
def mentions_in_range(spark, d):
    return readers.mentions(mentions(spark, d), "testa", 10, 150).select("id", "doc_id", "surfaceform", "annotation")


@query(f"SELECT id, annotation FROM {MENTIONS} WHERE type = 'testb' AND annotation <> 'none'")
def mentions_with_nil(spark, d):
    return readers.mentions(mentions(spark, d), "testb", keep_nil=True).select("id", "annotation")


@query(f"SELECT id, doc_id FROM {MENTIONS} WHERE type = 'train' AND annotation NOT IN ('none', 'NIL') AND id = 8")
def mention_by_id(spark, d):
    return readers.mentions(mentions(spark, d), "train", 8, 8).select("id", "doc_id")


@query(f"SELECT surfaceform FROM {MENTIONS} WHERE type = 'test' AND annotation NOT IN ('none', 'NIL')")
def surface_forms(spark, d):
    return readers.surface_forms(mentions(spark, d), "test")


@query(f"SELECT id, surfaceform FROM {MENTIONS} WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def mentions_by_ids(spark, d):
    ids = parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return readers.by_ids(mentions(spark, d).select("id", "surfaceform"), ids)


@query("SELECT p_partkey, coalesce(s_name, 'unknown') AS s_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def lookup_or_default(spark, d):
    names = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return readers.looked_up(parquet(spark, d, "part").select("p_partkey"), names, "p_partkey", "s_name", "unknown")


@query(f"SELECT label, score, query_id FROM {CANDIDATES}")
def column_subset(spark, d):
    return mx.subset(mx.subset(candidates(spark, d), without=["supplier", "pos"]), ["label", "score", "query_id"])


@query("SELECT page_id, '(' || page_id || ', ''' || lang || ''')' AS key, page_id AS query_id, lang AS entity FROM (SELECT page_id, split_part(url, '/', 4) AS lang FROM pages)")
def key_parse(spark, d):
    key = F.concat(F.lit("("), F.col("page_id").cast("string"), F.lit(", '"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit("')"))
    return mx.parse_key(parquet(spark, d, "pages").select("page_id", key.alias("key")), "key")


@query(f"SELECT c.query_id, c.entity, c.pos FROM {CANDIDATES} c WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = query_id AND l_partkey = entity AND l_returnflag = 'R')")
def candidate_whitelist(spark, d):
    allowed = parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("entity"))
    return cd.whitelisted(candidates(spark, d), allowed).select("query_id", "entity", "pos")


#: Priorities in the place of a recogniser's types.
TYPES = {"1-URGENT": "DATE", "2-HIGH": "PERSON", "3-MEDIUM": "MONEY", "4-NOT SPECIFIED": "LOCATION", "5-LOW": "NUMBER"}


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 'PERSON' WHEN '4-NOT SPECIFIED' THEN 'LOCATION' ELSE o_orderpriority END AS ner FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM', '5-LOW')")
def ner_types_excluded(spark, d):
    ner = F.col("o_orderpriority")
    for one, kind in TYPES.items():
        ner = F.when(F.col("o_orderpriority") == one, kind).otherwise(ner)
    return mn.without_types(parquet(spark, d, "orders").select("o_orderkey", ner.alias("ner")))


@query(f"SELECT query_id, entity, pos, (pos = 1)::INTEGER AS label FROM {CANDIDATES} WHERE query_id IN (SELECT query_id FROM {CANDIDATES} WHERE label = 1 AND pos > 2)")
def missed_gold(spark, d):
    rows = candidates(spark, d)
    return cd.missed_only(rows, rows.where("label = 1 and pos > 2").select("query_id")).select("query_id", "entity", "pos", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT n_nationkey FROM nation) OR l_suppkey IN (SELECT n_nationkey FROM nation)")
def either_in_list(spark, d):
    values = parquet(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("value"))
    return cd.any_of(parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], values)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
def category_contains(spark, d):
    return cd.in_category(parquet(spark, d, "part"), "p_type", "ECON").select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT unnest(list_value(n_nationkey, n_nationkey * 2, n_regionkey + 50)) FROM nation)")
def array_membership(spark, d):
    n = F.col("n_nationkey").cast("long")
    lists = parquet(spark, d, "nation").select(F.array(n, n * 2, F.col("n_regionkey").cast("long") + 50).alias("ids"))
    return cd.in_array(parquet(spark, d, "part").select("p_partkey", "p_name"), lists, "p_partkey", "ids")


@query(f"SELECT DISTINCT entity FROM {CANDIDATES} WHERE label = 0 AND entity NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_articles(spark, d):
    articles = parquet(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("entity"))
    return candidates(spark, d).where("label = 0").select("entity").distinct().join(articles, "entity", "left_anti")


@query("SELECT DISTINCT x.l_orderkey AS doc_id, x.l_linenumber AS sentence, x.l_partkey AS start, x.l_suppkey AS end FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber AND x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey WHERE x.l_quantity > 10 AND y.l_returnflag = 'A'")
def span_join(spark, d):
    spans = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sentence"), F.col("l_partkey").alias("start"), F.col("l_suppkey").alias("end"), "l_quantity", "l_returnflag")
    keys = ["doc_id", "sentence", "start", "end"]
    return mn.same_spans(spans.where("l_quantity > 10").select(*keys), spans.where("l_returnflag = 'A'").select(*keys)).distinct()


@query(f"SELECT query_id, entity, prior, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prior DESC, pos)::INTEGER AS rank FROM {CANDIDATES}) WHERE rank <= 5")
def top_by_prior(spark, d):
    return cd.top_candidates(candidates(spark, d), 5).select("query_id", "entity", "prior", "rank")


@query(f"SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY prior DESC, pos)::INTEGER AS rank FROM {CANDIDATES}")
def all_by_prior(spark, d):
    return cd.top_candidates(candidates(spark, d), 0).select("query_id", "entity", "rank")


@query(f"SELECT query_id, prior AS first_prior FROM {CANDIDATES} WHERE pos = 1")
def first_prior(spark, d):
    return cd.first_prior(candidates(spark, d)).select("query_id", "first_prior")


@query("SELECT c_custkey, md5(c_custkey || '-7') AS place FROM customer ORDER BY place, c_custkey")
def shuffled_rows(spark, d):
    return cd.shuffled(parquet(spark, d, "customer").select("c_custkey"), "c_custkey", 7).orderBy("place", "c_custkey")


@query("SELECT DISTINCT l.l_orderkey AS doc_id, l.l_partkey AS own, r.l_partkey AS entity FROM lineitem l JOIN lineitem r USING (l_orderkey) WHERE l.l_linenumber = 1 AND l.l_partkey <> r.l_partkey")
def union_minus_self(spark, d):
    lines = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity"), "l_linenumber")
    own = lines.where("l_linenumber = 1").select("doc_id", F.col("entity").alias("own"))
    return cd.others(own.join(lines.drop("l_linenumber"), "doc_id"), "doc_id", "entity", "own")


@query("SELECT p_brand AS doc_id, p_name AS surface, list(p_partkey ORDER BY p_partkey) AS offsets FROM part GROUP BY ALL")
def surface_offsets(spark, d):
    return mn.max_surface_offsets(parquet(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("surface"), F.col("p_partkey").alias("at")))


@query("SELECT p_brand AS doc_id, list(p_name ORDER BY p_partkey) AS mentions FROM part GROUP BY p_brand")
def document_mentions(spark, d):
    return mn.document_mentions(parquet(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("surface"), F.col("p_partkey").alias("at")))


@query("SELECT l_orderkey AS mention, list(DISTINCT l_partkey ORDER BY l_partkey) AS entities FROM lineitem GROUP BY l_orderkey")
def entity_sets(spark, d):
    return mn.entity_sets(parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("mention"), F.col("l_partkey").alias("entity")))


@query(f"SELECT outcome, margin, count(*) AS n FROM (SELECT CASE WHEN ok THEN 'right' ELSE 'wrong' END AS outcome, CASE WHEN n = 1 THEN -1 ELSE round_even(s1 - s2, 0) END AS margin FROM (SELECT query_id, count(*) AS n, max(score / 100) FILTER (k = 1) AS s1, max(score / 100) FILTER (k = 2) AS s2, max(score / 100) FILTER (label = 1) AS g, coalesce(g > max(score / 100) FILTER (label = 0), n = 1) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM {CANDIDATES}) GROUP BY query_id) WHERE ok OR g = s2 OR n = 1) GROUP BY ALL")
def margin_histogram(spark, d):
    return ev.margin_histogram(candidates(spark, d).withColumn("score", F.col("score") / 100))


@query(f"""WITH o AS (SELECT query_id, max(CASE WHEN label = 1 THEN score END) AS g, max(CASE WHEN label = 0 THEN score END) AS b, max(CASE WHEN label = 1 THEN entity END) AS entity FROM {CANDIDATES} GROUP BY query_id)
    SELECT o_custkey AS doc_id, p_brand AS category, count(*) AS n, count(*) FILTER (NOT (g > b OR b IS NULL)) AS errors, coalesce(list(query_id ORDER BY query_id) FILTER (NOT (g > b OR b IS NULL)), []) AS wrong FROM o JOIN orders ON query_id = o_orderkey LEFT JOIN part ON p_partkey = entity GROUP BY ALL""")
def errors_by_category(spark, d):
    own = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    brands = parquet(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("category"))
    return ev.errors_by_category(candidates(spark, d).join(own, "query_id"), brands)


@query(f"SELECT round(avg(1.0 / r), 9) AS mean_reciprocal_rank FROM (SELECT label, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM {CANDIDATES}) WHERE label = 1")
def evaluator_of_choice(spark, d):
    from tessera.operators.ranking import gold_rank

    reciprocal = lambda df: gold_rank(df, "query_id", "score", "label").agg(F.round(F.avg(1.0 / F.col("gold_rank")), 9).alias("mean_reciprocal_rank"))
    return ev.evaluated(candidates(spark, d), reciprocal)


@query(f"""SELECT lang, source, doc_id, round(sum(entropy), 7) AS etp_sum, round(sum(entropy * w), 7) AS w_etp_sum, round(max(entropy), 7) AS max_etp, round(sum(idf), 7) AS idf_sum, round(sum(idf * w), 7) AS w_idf_sum, round(max(idf), 7) AS max_idf,
    round(sum(tf * idf), 7) AS tf_idf_sum, round(sum(tf * idf * w), 7) AS w_tf_idf_sum, round(max(tf * idf), 7) AS max_tf_idf, round(sum(tf * entropy), 7) AS tf_entropy_sum, round(sum(tf * entropy * w), 7) AS w_tf_entropy_sum, round(max(tf * entropy), 7) AS max_tf_entropy
    FROM {MENTION} JOIN {TF} USING (lang, source, token) JOIN {SPREAD} USING (lang, source, token) GROUP BY lang, source, doc_id""")
def token_overlap_12(spark, d):
    rows = docs(spark, d)
    n = stored(tk.counts(rows, GROUP, "doc_id"))
    first = rows.groupBy(*GROUP).agg(F.min("doc_id").alias("doc_id"))
    mention = n.join(first, [*GROUP, "doc_id"]).groupBy(*GROUP, "token").agg(F.sum("n").alias("w"))
    shared = tk.shared_counts(n, mention, GROUP)
    out = tk.older_statistics(mention, tk.term_frequency(shared, GROUP, "doc_id"), tk.spread(shared, rows, GROUP), GROUP, "doc_id")
    return out.select(*GROUP, "doc_id", *(F.round(c, 7).alias(c) for c in out.columns[3:]))


@query(f"SELECT lang, source, doc_id, token, round(n / sum(n) OVER (PARTITION BY lang, source, doc_id) * log2(size / count(*) OVER (PARTITION BY lang, source, token)), 6) AS tf_idf FROM {COUNTS} JOIN {SIZES} USING (lang, source)")
def tf_idf_log2(spark, d):
    rows = docs(spark, d)
    return tk.log2_tf_idf(stored(tk.counts(rows, GROUP, "doc_id")), rows, GROUP, "doc_id").withColumn("tf_idf", F.round("tf_idf", 6))


STOPS = "(SELECT unnest(['the', 'and', 'of', 'die', 'und', 'la', 'de', 'el', 'y', 'license']) AS token)"
#: Two words of which the first has seven letters make an entity, but for overlaps with the one before.
ENTITIES = f"""(SELECT doc_id, pos::INTEGER AS s, (pos + 2)::INTEGER AS e, token || ' ' || after AS entity FROM (SELECT *, lead(token) OVER w AS after, lag(length(token) = 7) OVER w AS was FROM {PLACED} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    WHERE length(token) = 7 AND length(after) <> 7 AND after IS NOT NULL)"""


def token_layer(spark, d):
    from pyspark.sql.window import Window

    # Dealt as texts: tokens stay where their document is.
    rows = tk.exploded(tk.dealt(docs(spark, d).select("doc_id", "text"), "doc_id"), "doc_id")
    after = F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos"))
    found = rows.withColumn("after", after).where("length(token) = 7 and length(after) <> 7 and after is not null")
    stops = spark.createDataFrame([(w,) for w in ("the", "and", "of", "die", "und", "la", "de", "el", "y", "license")], "token string")
    return rows, stops, found.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"), F.concat_ws(" ", "token", "after").alias("entity"))


MEANINGFUL = f"""(SELECT p.doc_id, p.pos, coalesce(x.entity, p.token) AS token, z.tail FROM {PLACED} p LEFT JOIN {ENTITIES} x ON x.doc_id = p.doc_id AND p.pos >= x.s AND p.pos < x.e
    LEFT JOIN (SELECT doc_id, max(e) AS tail FROM {ENTITIES} GROUP BY doc_id) z ON z.doc_id = p.doc_id
    WHERE CASE WHEN x.entity IS NULL THEN p.token NOT IN (SELECT token FROM {STOPS}) {{more}} ELSE p.pos = x.s END)"""


@query("SELECT doc_id, count(*) AS n, md5(string_agg(pos || ':' || token, '|' ORDER BY pos)) AS line FROM " + MEANINGFUL.replace("{more}", "") + " GROUP BY doc_id")
def meaningful_tokens(spark, d):
    return line(tk.meaningful(*token_layer(spark, d)))


@query("SELECT doc_id, count(*) AS n, md5(string_agg(pos || ':' || token, '|' ORDER BY pos)) AS line FROM " + MEANINGFUL.replace("{more}", "OR p.pos >= coalesce(z.tail, 0)") + " GROUP BY doc_id")
def spliced_tokens(spark, d):
    return line(tk.spliced(*token_layer(spark, d)))


def line(rows):
    cells = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: F.concat_ws(":", x["pos"].cast("string"), x["token"]))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(cells, "|").cast("binary")).alias("line"))


@query(r"SELECT p_partkey, regexp_extract_all(lower(p_name || ', ' || p_brand), '[\p{L}\p{N}_]+') AS lemmas FROM part")
def phrase_lemmas(spark, d):
    return parquet(spark, d, "part").select("p_partkey", tx.tokens(F.concat_ws(", ", "p_name", "p_brand")).alias("lemmas"))


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*') AS runs, regexp_split_to_array(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*') AS gaps FROM documents),
    x AS (SELECT doc_id, unnest(runs) AS span, unnest(gaps[:len(runs)]) AS gap, generate_subscripts(runs, 1) AS nth FROM r WHERE len(runs) > 0)
    SELECT doc_id, span, (sum(length(gap) + length(span)) OVER (PARTITION BY doc_id ORDER BY nth) - length(span))::INTEGER AS start FROM x""")
def capitalised_spans(spark, d):
    return mn.capitalised_spans(docs(spark, d))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS token FROM lineitem), i AS (SELECT p_partkey AS token, p_retailprice AS idf FROM part WHERE p_size > 25),
    m AS (SELECT l_orderkey AS entity, l_partkey AS token, max(l_discount) AS mi FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), c AS (SELECT l_partkey AS token, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT entity, token, round(coalesce(idf, log2(1000)), 6) AS idf, coalesce(mi, 0.001) AS mi, round(log2(1000 / (coalesce(n, 0) + 1)), 6) AS aida FROM t LEFT JOIN i USING (token) LEFT JOIN m USING (entity, token) LEFT JOIN c USING (token)""")
def token_weights(spark, d):
    lines = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("token"), "l_discount", "l_returnflag")
    idf = parquet(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("token"), F.col("p_retailprice").alias("idf"))
    mi = lines.where("l_returnflag = 'A'").groupBy("entity", "token").agg(F.max("l_discount").alias("mi"))
    seen = lines.where("l_returnflag = 'R'").groupBy("token").agg(F.count("*").alias("count"))
    out = tk.token_weights(lines.select("entity", "token").distinct(), idf, mi, seen, 1000)
    return out.select("entity", "token", F.round("idf", 6).alias("idf"), "mi", F.round("aida", 6).alias("aida"))


@query("""WITH p AS (SELECT l_orderkey AS query_id, 'widget' AS mention, l_suppkey AS tuple, CASE WHEN l_quantity > 45 THEN 'NULL' ELSE p_name END AS phrase FROM lineitem JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, CASE WHEN lower(phrase) <> 'cold widget' AND (contains(lower(phrase), mention) OR contains(mention, lower(phrase))) THEN 0 ELSE 1 END AS distance FROM p WHERE lower(phrase) <> 'null')
    SELECT DISTINCT query_id, distance, phrase FROM r WHERE (query_id, tuple) IN (SELECT (query_id, tuple) FROM r WHERE distance = 0)""")
def keyphrase_proximity(spark, d):
    names = parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    phrase = F.when(F.col("l_quantity") > 45, "NULL").otherwise(F.col("p_name"))
    rows = parquet(spark, d, "lineitem").join(names, "l_partkey").select(F.col("l_orderkey").alias("query_id"), F.lit("widget").alias("mention"), F.col("l_suppkey").alias("tuple"), phrase.alias("phrase"))
    return tk.proximity(rows, spark.createDataFrame([("cold widget",)], "token string"))


KEYPHRASES = """WITH l AS (SELECT l_suppkey AS doc, l_orderkey AS phrase, p_size AS token, l_linenumber AS pos, l_quantity AS idf, l_discount AS mi, l_returnflag AS f FROM lineitem JOIN part ON p_partkey = l_partkey),
    e AS (SELECT * FROM l WHERE f = 'A'), m AS (SELECT * FROM l WHERE f = 'R'), t AS (SELECT doc, phrase, sum(idf) AS t_idf, sum(mi) AS t_mi FROM e GROUP BY ALL),
    p AS (SELECT e.doc, e.phrase AS ep, m.phrase AS mp, count(DISTINCT e.token) AS matches, max(m.pos) - min(m.pos) + 1 AS cover, sum(e.idf) AS m_idf, sum(e.mi) AS m_mi FROM e JOIN m ON e.doc = m.doc AND e.token = m.token GROUP BY ALL),
    b AS (SELECT p.doc, ep, max(t_idf * matches / cover * power(m_idf / t_idf, 2)) AS idf, max(CASE WHEN t_mi > 0 THEN t_mi * matches / cover * power(m_mi / t_mi, 2) ELSE 0 END) AS mi FROM p JOIN t ON t.doc = p.doc AND t.phrase = ep GROUP BY ALL)
    SELECT doc, round(sum(idf), 3) AS idf_total, round(sum(mi), 6) AS mi_total, round(max(idf), 6) AS max_idf, round(max(mi), 6) AS max_mi FROM b GROUP BY doc"""


@query(KEYPHRASES)
def keyphrase_totals(spark, d):
    lines = parquet(spark, d, "lineitem").join(parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("token")), "l_partkey")
    lines = lines.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("phrase"), "token", F.col("l_linenumber").alias("pos"), "l_quantity", "l_discount", "l_returnflag")
    mention = lines.where("l_returnflag = 'R'").select("doc", "phrase", "token", "pos")
    out = None
    for name, weight, digits in (("idf", "l_quantity", 3), ("mi", "l_discount", 6)):
        entity = lines.where("l_returnflag = 'A'").select("doc", "phrase", "token", F.lit(0).alias("pos"), F.col(weight).alias("weight"))
        one = co.phrase_similarity(entity, mention, ["doc"]).select("doc", F.round("similarity", digits).alias(f"{name}_total"), F.round("highest", 6).alias(f"max_{name}"))
        out = one if out is None else out.join(one, "doc")
    return out


@query(f"SELECT a, b, round(CASE WHEN common > 0 THEN common * {sim.UNIVERSE}.0 / (da * db) ELSE 0 END, 4) AS pmi FROM {LINKS}")
def pmi_plain(spark, d):
    m = paired(spark, d)
    links = co.pair_links(co.document_pairs(m, m), edges(spark, d))
    return links.select("a", "b", F.round(sim.pmi(F.col("common"), F.col("degree_a"), F.col("degree_b"), normalized=False), 4).alias("pmi"))


RANKS = f"(SELECT o_custkey AS doc_id, query_id, entity, pos AS rank FROM {CANDIDATES} JOIN orders ON query_id = o_orderkey)"


@query(f"SELECT a.doc_id, a.query_id, a.entity, b.query_id AS other_query, b.entity AS other FROM {RANKS} a JOIN {RANKS} b ON a.doc_id = b.doc_id AND a.query_id <> b.query_id AND a.entity <> b.entity WHERE b.rank <= 1")
def pairs_with_top(spark, d):
    own = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    rows = candidates(spark, d).join(own, "query_id").select("doc_id", "query_id", "entity", F.col("pos").alias("rank"))
    return co.document_pairs(rows, rows, k=1)


@query("SELECT doc_id, text, coalesce(text, '') = '' AS empty FROM documents")
def unescaped(spark, d):
    # Every letter e and every line end is written as an escape first.
    coded = F.replace(F.replace("text", F.lit("e"), F.lit("\\u0065")), F.lit("\n"), F.lit("\\u000a"))
    plain = parquet(spark, d, "documents").select("doc_id", tx.unescape_entity(coded).alias("text"))
    return plain.withColumn("empty", F.coalesce("text", F.lit("")) == "")


@query("SELECT n_nationkey AS doc_id, 0 AS sentence, n_regionkey AS start, n_regionkey + 2 AS end, 'PERSON' AS ner, n_name AS text FROM nation WHERE n_regionkey <> 2")
def recogniser_answers(spark, d):
    ner = F.when(F.col("n_regionkey") == 2, "MONEY").otherwise(F.lit("PERSON"))
    answer = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.array(F.struct(F.col("n_regionkey").alias("tokenBegin"), (F.col("n_regionkey") + 2).alias("tokenEnd"), ner.alias("ner"), F.col("n_name").alias("text"))).alias("entitymentions"))).alias("sentences")))
    return mn.without_types(readers.entity_spans(parquet(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), answer.alias("json")), "json"))


@query("SELECT n_nationkey AS doc_id, 7 AS chain, n_regionkey AS sentence, 1 AS start, 3 AS end, n_name AS text, n_nationkey % 2 = 0 AS is_representative FROM nation")
def coref_answers(spark, d):
    one = F.struct((F.col("n_regionkey") + 1).alias("sentNum"), F.lit(2).alias("startIndex"), F.lit(4).alias("endIndex"), F.col("n_name").alias("text"), (F.col("n_nationkey") % 2 == 0).alias("isRepresentativeMention"))
    answer = F.to_json(F.struct(F.create_map(F.lit("7"), F.array(one)).alias("corefs")))
    return readers.coref_chains(parquet(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), answer.alias("json")), "json")


def _places(name: str, pattern: str) -> str:
    """SQL of every match of a pattern and its place."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, span, (sum(length(gap) + length(span)) OVER (PARTITION BY doc_id ORDER BY nth) - length(span))::INTEGER AS start FROM (
        SELECT doc_id, unnest(runs) AS span, unnest(gaps[:len(runs)]) AS gap, generate_subscripts(runs, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS runs, regexp_split_to_array(text, '{pattern}') AS gaps FROM documents) WHERE len(runs) > 0))"""


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


CHAINS = rf"""WITH RECURSIVE {_places('caps', r'\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*')}, {_places('toks', r'[\p{L}\p{N}_]+')},
    m AS MATERIALIZED (SELECT *, lower(text) AS key, lower(text) IN {_list(cr.PLURAL)} OR (lower(text) NOT IN {_list(cr.SINGULAR)} AND (contains(lower(text), ' and ') OR regexp_matches(lower(text), '[^s]s$'))) AS several FROM (
        SELECT doc_id, start, min(text) AS text, arg_min(pronoun, text) AS pronoun FROM (
        SELECT doc_id, start, span AS text, lower(span) IN {_list(cr.SINGULAR + cr.PLURAL)} AS pronoun FROM caps UNION ALL SELECT doc_id, start, span, TRUE FROM toks WHERE span IN {_list(cr.SINGULAR + cr.PLURAL)}) GROUP BY doc_id, start)),
    b AS MATERIALIZED (SELECT *, CASE WHEN pronoun THEN last_value(CASE WHEN NOT pronoun AND several THEN key END IGNORE NULLS) OVER w END AS before_p, CASE WHEN pronoun THEN last_value(CASE WHEN NOT pronoun AND NOT several THEN key END IGNORE NULLS) OVER w END AS before_s
        FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    firsts AS MATERIALIZED (SELECT doc_id, key, min(start) AS first FROM m WHERE NOT pronoun GROUP BY doc_id, key),
    tails AS (SELECT doc_id, start, key AS whole, array_to_string(w[k:], ' ') AS tail FROM (SELECT doc_id, start, key, string_split(key, ' ') AS w, unnest(range(2, len(string_split(key, ' ')) + 1)) AS k FROM m WHERE NOT pronoun)),
    parents AS MATERIALIZED (SELECT f.doc_id, f.key, first, arg_max(whole, t.start) AS parent FROM firsts f LEFT JOIN tails t ON t.doc_id = f.doc_id AND t.tail = f.key AND t.start < f.first GROUP BY ALL),
    up AS (SELECT doc_id, key, key AS top FROM parents UNION ALL SELECT up.doc_id, up.key, p.parent FROM up JOIN parents p ON p.doc_id = up.doc_id AND p.key = up.top WHERE p.parent IS NOT NULL),
    roots AS (SELECT up.doc_id, up.key, p.first AS root FROM up JOIN parents p ON p.doc_id = up.doc_id AND p.key = up.top WHERE p.parent IS NULL)
    SELECT b.doc_id, b.start, b.text, coalesce(r.root, b.start) AS chain,
        CASE WHEN pronoun THEN CASE WHEN r.root IS NULL THEN 'none' ELSE 'pronoun' END WHEN b.start > p.first THEN 'exact' WHEN p.parent IS NOT NULL THEN 'suffix' ELSE 'none' END AS sieve
    FROM b LEFT JOIN roots r ON r.doc_id = b.doc_id AND r.key = CASE WHEN NOT pronoun THEN b.key WHEN several THEN before_p ELSE before_s END LEFT JOIN parents p ON p.doc_id = b.doc_id AND p.key = b.key AND NOT b.pronoun"""


@query(CHAINS)
def coreference_chains(spark, d):
    """Every mention with its chain and the sieve that put it there."""
    return cr.chains(cr.mentions(docs(spark, d)))


LEMMA_RULES = rf"""v AS MATERIALIZED (SELECT token AS word, count(*) AS n FROM {PLACED} WHERE regexp_matches(token, '^\p{{L}}+$') GROUP BY token),
    c AS (SELECT right(word, {lm.CLASS}) AS class, strip, added, left(word, length(word) - strip) || added AS lemma, n, word FROM v, (SELECT unnest(range(1, {lm.STRIP + 1})) AS strip), (SELECT unnest({lm.ADDED}) AS added) WHERE length(word) >= {lm.LEAST} AND length(word) - strip >= {lm.KEPT}),
    h AS (SELECT class, strip, added, count(*) AS support FROM c JOIN v ON v.word = c.lemma AND v.n >= c.n WHERE lemma <> c.word GROUP BY ALL),
    rules AS MATERIALIZED (SELECT class, strip::INTEGER AS strip, added, support, words FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY support DESC, strip, added) AS k FROM h)
        JOIN (SELECT right(word, {lm.CLASS}) AS class, count(*) AS words FROM v WHERE length(word) >= {lm.LEAST} GROUP BY ALL) USING (class) WHERE k = 1 AND support >= 3 AND support >= 0.25 * words)"""
LEMMA = f"CASE WHEN r.class IS NOT NULL AND length(token) - strip >= {lm.KEPT} THEN left(token, length(token) - strip) || added ELSE token END"
LEMMA_JOIN = rf"LEFT JOIN rules r ON r.class = right(token, {lm.CLASS}) AND length(token) >= {lm.LEAST} AND regexp_matches(token, '^\p{{L}}+$')"


def _rules(spark, d):
    return stored(lm.induce(lm.vocabulary(tk.exploded(docs(spark, d), "doc_id"))))


@query(f"WITH {LEMMA_RULES} SELECT * FROM rules")
def lemma_rules(spark, d):
    """The edit script of each suffix class of the documents' words."""
    return _rules(spark, d)


@query(f"WITH {LEMMA_RULES} SELECT doc_id, count(*) AS n, md5(string_agg(pos || ':' || lemma, '|' ORDER BY pos)) AS line FROM (SELECT doc_id, pos, {LEMMA} AS lemma FROM {PLACED} {LEMMA_JOIN}) GROUP BY doc_id")
def document_lemmas(spark, d):
    """Every document's tokens as lemmas."""
    rows = lm.lemmatised(tk.exploded(docs(spark, d), "doc_id"), _rules(spark, d))
    return line(rows.select("doc_id", "pos", F.col("lemma").alias("token")))


@query(rf"""WITH {LEMMA_RULES}, p AS (SELECT p_partkey, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT p_partkey, regexp_extract_all(lower(p_name || ', ' || p_type || 's'), '[\p{{L}}\p{{N}}_]+') AS t FROM part))
    SELECT p_partkey, string_agg(lemma, ' ' ORDER BY pos) AS lemmas FROM (SELECT p_partkey, pos, {LEMMA} AS lemma FROM p {LEMMA_JOIN}) GROUP BY p_partkey""")
def phrase_lemmas_induced(spark, d):
    """Whole phrases as lemmas, by the scripts of the documents."""
    part = parquet(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("s")).alias("text"))
    rows = lm.lemmatised(tk.exploded(part, "p_partkey"), _rules(spark, d))
    return rows.groupBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "lemma"))), lambda x: x["lemma"]), " ").alias("lemmas"))


def _taught(spark, d):
    """Documents, the spans that teach the tagger, a tagger of four fifths of the documents, and which those are."""
    rows = docs(spark, d).select("doc_id", "text")
    taught = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5 > 0
    spans = stored(mn.capitalised_spans(rows))
    return rows, spans, tg.train(rows.where(taught), spans, passes=2), taught


@query()
def recognised_spans(spark, d):
    """Spans that the trained tagger finds in every document."""
    rows, _, model, _ = _taught(spark, d)
    return tg.recognise(rows, model)


@query()
def recogniser_quality(spark, d):
    """Precision and recall of the tagger on the documents that did not teach it."""
    rows, spans, model, taught = _taught(spark, d)
    q = tg.quality(tg.recognise(rows.where(~taught), model), spans.where(~taught))
    return q.select("n_found", "n_spans", "n_right", F.round("p", 4).alias("p"), F.round("r", 4).alias("r"))


@query("SELECT o_custkey AS key, o_orderkey, coalesce(o_orderpriority, 'none') AS priority FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part WHERE p_size = 7) UNION ALL SELECT p_partkey, NULL, 'none' FROM part WHERE p_size = 7 AND p_partkey NOT IN (SELECT o_custkey FROM orders)")
def indexed_lookup(spark, d):
    """Keys beside their rows in a table that is written for lookups, unknown ones with a default."""
    path = fresh_path(spark)
    write_indexed(parquet(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderpriority").alias("priority")), path, "key", 16)
    keys = parquet(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("key"))
    kind = parquet(spark, d, "orders").schema["o_custkey"].dataType.simpleString()
    return Lookup(spark, path, "key", kind, 16).joined(keys, {"priority": "none"})
