"""Token statistics, strings, spans and link coherence over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import coherence as co
from tessera.operators import mentions as mn
from tessera.operators import tokens as tk
from tessera.plans.registry import query
from tessera.plans.views import EDGES, GROUP, PAIRED, PLACED, TOKENS, edges, paired
from tessera.sources.readers import parquet
from tessera.sources.workspace import stored


def docs(spark, d):
    return parquet(spark, d, "documents").select("doc_id", "text", *GROUP)


@query(f"SELECT doc_id, token, count(*) AS n, md5(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS places FROM {PLACED} GROUP BY doc_id, token")
def token_index(spark, d):
    found = tk.index(docs(spark, d), "doc_id")
    return found.select("doc_id", "token", F.size("positions").cast("long").alias("n"), F.md5(F.array_join("positions", ",").cast("binary")).alias("places"))


COUNTS = f"(SELECT lang, source, doc_id, token, count(*) AS n FROM {TOKENS} GROUP BY ALL)"
SIZES = "(SELECT lang, source, count(*) AS size FROM documents GROUP BY ALL)"
SPREAD = f"""(SELECT lang, source, token, df, log10(size / df) AS idf,
    CASE WHEN k + (size > df)::INTEGER > 1 THEN (h + CASE WHEN size > df THEN -((size - df) / size) * log10((size - df) / size) ELSE 0 END) / log10(k + (size > df)::INTEGER)
    ELSE h + CASE WHEN size > df THEN -((size - df) / size) * log10((size - df) / size) ELSE 0 END END AS entropy
    FROM (SELECT lang, source, token, sum(c) AS df, max(size) AS size, sum(-(c / size) * log10(c / size)) AS h, count(*) AS k
    FROM (SELECT lang, source, token, n, count(*) AS c FROM {COUNTS} GROUP BY ALL) JOIN {SIZES} USING (lang, source) GROUP BY lang, source, token))"""
TF = f"(SELECT lang, source, doc_id, token, n, n / sum(n) OVER (PARTITION BY lang, source, doc_id) AS tf FROM {COUNTS})"


@query(f"SELECT lang, source, token, df::BIGINT AS df, round(idf, 6) AS idf, round(entropy, 6) AS entropy FROM {SPREAD}")
def freq_entropy(spark, d):
    rows = docs(spark, d)
    return tk.spread(tk.counts(rows, GROUP, "doc_id"), rows, GROUP).select(*GROUP, "token", "df", F.round("idf", 6).alias("idf"), F.round("entropy", 6).alias("entropy"))


@query(f"SELECT doc_id, token, round(tf * idf, 6) AS tf_idf FROM {TF} JOIN {SPREAD} USING (lang, source, token)")
def tf_idf(spark, d):
    rows = docs(spark, d)
    n = stored(tk.counts(rows, GROUP, "doc_id"))
    joined = tk.term_frequency(n, GROUP, "doc_id").join(tk.spread(n, rows, GROUP), [*GROUP, "token"])
    return joined.select("doc_id", "token", F.round(F.col("tf") * F.col("idf"), 6).alias("tf_idf"))


MENTION = f"(SELECT lang, source, token, sum(n) AS w FROM {COUNTS} JOIN (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL) USING (lang, source, doc_id) GROUP BY ALL)"


@query(f"""SELECT lang, source, doc_id, round(sum(entropy), 4) AS etp_sum, round(sum(entropy * w), 4) AS w_etp_sum, round(min(entropy), 4) AS min_etp, round(sum(idf), 4) AS idf_sum, round(sum(idf * w), 4) AS w_idf_sum, round(max(idf), 4) AS max_idf,
    round(sum(tf * idf), 4) AS tf_idf_sum, round(sum(tf * idf * w), 4) AS w_tf_idf_sum, round(max(tf * idf), 4) AS max_tf_idf, round(sum(tf * idf * entropy), 4) AS tf_idf_entropy_sum, round(sum(tf * entropy), 4) AS tf_entropy_sum
    FROM {MENTION} JOIN {TF} USING (lang, source, token) JOIN {SPREAD} USING (lang, source, token) GROUP BY lang, source, doc_id""")
def token_overlap_11(spark, d):
    rows = docs(spark, d)
    n = stored(tk.counts(rows, GROUP, "doc_id"))
    first = rows.groupBy(*GROUP).agg(F.min("doc_id").alias("doc_id"))
    mention = n.join(first, [*GROUP, "doc_id"]).groupBy(*GROUP, "token").agg(F.sum("n").alias("w"))
    shared = tk.shared_counts(n, mention, GROUP)
    out = tk.overlap_statistics(mention, tk.term_frequency(shared, GROUP, "doc_id"), tk.spread(shared, rows, GROUP), GROUP, "doc_id")
    return out.select(*GROUP, "doc_id", *(F.round(c, 4).alias(c) for c in out.columns[3:]))


@query(f"""SELECT lang, source, doc_id, round(sum((0.1 * s + 0.9 * entropy) * tf), 4) AS mix_0_1, round(sum((0.5 * s + 0.5 * entropy) * tf), 4) AS mix_0_5, round(sum((0.9 * s + 0.1 * entropy) * tf), 4) AS mix_0_9, round(sum((1.5 * s - 0.5 * entropy) * tf), 4) AS mix_1_5, round(sum((1.9 * s - 0.9 * entropy) * tf), 4) AS mix_1_9
    FROM (SELECT *, coalesce((idf - min(idf) OVER w) / nullif(max(idf) OVER w - min(idf) OVER w, 0), 0) AS s FROM {TF} JOIN {SPREAD} USING (lang, source, token) WINDOW w AS (PARTITION BY lang, source, doc_id)) GROUP BY lang, source, doc_id""")
def idf_entropy_mix(spark, d):
    rows = docs(spark, d)
    n = stored(tk.counts(rows, GROUP, "doc_id"))
    joined = tk.term_frequency(n, GROUP, "doc_id").join(tk.spread(n, rows, GROUP), [*GROUP, "token"])
    out = tk.idf_entropy_mix(joined, [*GROUP, "doc_id"])
    return out.select(*GROUP, "doc_id", *(F.round(c, 4).alias(c) for c in out.columns[3:]))


@query("""WITH m AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, token, count(*) AS a FROM m GROUP BY ALL),
    e AS (SELECT conv_id, turn AS entity, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'assistant'), b AS (SELECT conv_id, entity, token, count(*) AS b FROM e GROUP BY ALL),
    c AS (SELECT a.conv_id, a.token, x.entity FROM a JOIN (SELECT DISTINCT conv_id, entity FROM b) x USING (conv_id))
    SELECT c.conv_id, c.token, c.entity, coalesce(a.a * b.b, 0)::BIGINT AS value FROM c LEFT JOIN a USING (conv_id, token) LEFT JOIN b ON b.conv_id = c.conv_id AND b.entity = c.entity AND b.token = c.token""")
def cooccurrence_matrix(spark, d):
    rows = parquet(spark, d, "conversations").select("conv_id", F.col("turn").alias("entity"), "role", "text")
    n = tk.exploded(rows, "conv_id", "entity", "role")
    mention = n.where("role = 'user'").groupBy("conv_id", "token").agg(F.count("*").alias("n"))
    entity = n.where("role = 'assistant'").groupBy("conv_id", "entity", "token").agg(F.count("*").alias("n"))
    return tk.cooccurrence(mention, entity, ["conv_id"]).select("conv_id", "token", "entity", "value")


@query(f"""WITH p AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM {PLACED})
    SELECT c.doc_id, c.token AS target, c.pos::INTEGER AS centre, count(*) AS n, count(DISTINCT x.token) AS n_tokens FROM p c JOIN p x ON c.doc_id = x.doc_id AND abs(x.pos - c.pos) <= 5 AND x.pos <> c.pos AND x.pos < x.last
    WHERE c.token IN ('license', 'token', 'idiot') GROUP BY ALL""")
def context_window(spark, d):
    targets = spark.createDataFrame([("license",), ("token",), ("idiot",)], "token string")
    near = tk.context_windows(docs(spark, d), ["doc_id"], targets, 5)
    return near.groupBy("doc_id", "target", "centre").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_tokens"))


@query("""WITH s AS (SELECT p_brand AS doc_id, p_name AS surface, p_size AS place, p_partkey AS seq FROM part), m AS (SELECT p_partkey AS query_id, p_brand AS doc_id, split_part(p_name, ' ', 2) AS mention, p_size AS o FROM part),
    r AS (SELECT query_id, surface, row_number() OVER (PARTITION BY query_id ORDER BY (o <> place)::INTEGER, (o < place)::INTEGER, abs(o - place), seq) AS k FROM m JOIN s USING (doc_id)
    WHERE length(surface) > length(mention) AND (starts_with(lower(surface), lower(mention)) OR suffix(lower(surface), lower(mention))))
    SELECT query_id, coalesce(surface, mention) AS surface FROM m LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (query_id)""")
def nearest_mention(spark, d):
    part = parquet(spark, d, "part")
    surfaces = part.select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("surface"), F.col("p_size").alias("at"), F.col("p_partkey").alias("seq"))
    mentions = part.select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("doc_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("mention"), F.col("p_size").alias("offset"))
    return mn.nearest_related(mentions, surfaces)


PAIRS = f"(SELECT x.doc_id, x.query_id, x.entity, y.query_id AS other_query, y.entity AS other FROM {PAIRED} x JOIN {PAIRED} y ON x.doc_id = y.doc_id AND x.query_id <> y.query_id AND x.entity <> y.entity)"
LINKS = f"""(SELECT a, b, coalesce(common, 0) AS common, da, db FROM (SELECT DISTINCT least(entity, other) AS a, greatest(entity, other) AS b FROM {PAIRS})
    LEFT JOIN (SELECT x.dst AS a, y.dst AS b, count(*) AS common FROM {EDGES} x JOIN {EDGES} y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL) USING (a, b)
    JOIN (SELECT dst AS a, count(*) AS da FROM {EDGES} GROUP BY ALL) USING (a) JOIN (SELECT dst AS b, count(*) AS db FROM {EDGES} GROUP BY ALL) USING (b))"""
SIMS = f"""(SELECT a, b, CASE WHEN common > 0 THEN common / least(da, db) ELSE 0 END AS pmi, CASE WHEN common > 0 THEN 1 - (ln(greatest(da, db)) - ln(common)) / (ln({sim.UNIVERSE}) - ln(least(da, db))) ELSE 0 END AS ngd,
    ln(common + 1) / ln(da + db - common + 1) AS njs FROM {LINKS})"""
SCORED = f"(SELECT p.*, pmi, ngd, njs FROM {PAIRS} p JOIN {SIMS} s ON s.a = least(entity, other) AND s.b = greatest(entity, other))"


@query(f"SELECT a, b, common::BIGINT AS common, da AS degree_a, db AS degree_b FROM {LINKS}")
def link_intersection(spark, d):
    m = paired(spark, d)
    return co.pair_links(co.document_pairs(m, m), edges(spark, d))


@query(f"SELECT a, b, round(pmi, 6) AS pmi, round(ngd, 6) AS ngd, round(njs, 6) AS njs FROM {SIMS}")
def ngd_pmi_njs(spark, d):
    m = paired(spark, d)
    out = co.similarities(co.pair_links(co.document_pairs(m, m), edges(spark, d)), sim.UNIVERSE)
    return out.select("a", "b", *(F.round(c, 6).alias(c) for c in ("pmi", "ngd", "njs")))


@query("""WITH l AS (SELECT *, l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s FROM lineitem), e AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN s ELSE p END AS src, CASE WHEN l_returnflag = 'R' THEN p ELSE s END AS dst FROM l),
    q AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e UNION SELECT least(x.p, y.s), greatest(x.p, y.s) FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1)
    SELECT a, b, f.src IS NOT NULL OR g.src IS NOT NULL AS is_linked, f.src IS NOT NULL AND g.src IS NOT NULL AS is_mutual
    FROM q LEFT JOIN e f ON f.src = a AND f.dst = b LEFT JOIN e g ON g.src = b AND g.dst = a""")
def mutual_link(spark, d):
    # Parts have even ids, suppliers odd ones.  A returned line links its supplier to its part, any other
    # line its part to its supplier; each part is also asked with the supplier of its order's next line.
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("back"), (F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") * 2 + 1).alias("supplier"))
    e = lines.select(F.when(F.col("back"), F.col("supplier")).otherwise(F.col("part")).alias("src"), F.when(F.col("back"), F.col("part")).otherwise(F.col("supplier")).alias("dst")).distinct()
    later = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("supplier").alias("other"))
    asked = e.union(lines.join(later, ["l_orderkey", "l_linenumber"]).select("part", "other"))
    return co.linked(asked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), e)


def scored(spark, d):
    """Pairs with their similarities; mentions are stored, as they are read for what is asked and for the pairs."""
    m = stored(paired(spark, d))
    return co.scored_documents(m, m, edges(spark, d), sim.UNIVERSE)


@query(f"""SELECT doc_id, query_id, entity, round(max(pmi), 6) AS max_pmi, round(max(ngd), 6) AS max_ngd, round(sum(pmi) / count(*), 9) AS avg_pmi, round(sum(ngd) / count(*), 9) AS avg_ngd
    FROM (SELECT doc_id, query_id, entity, other, max(pmi) AS pmi, max(ngd) AS ngd FROM {SCORED} GROUP BY ALL) GROUP BY ALL""")
def coherence_max_avg(spark, d):
    out = co.max_and_mean(scored(spark, d), ["pmi", "ngd"])
    return out.select("doc_id", "query_id", "entity", *(F.round(c, 6 if c.startswith("max") else 9).alias(c) for c in out.columns[3:]))


@query(f"""SELECT doc_id, query_id, entity, round(max(hi), 6) AS max_max, round(avg(hi), 6) AS avg_max, round(max(mid), 6) AS max_avg, round(avg(mid), 6) AS avg_avg
    FROM (SELECT doc_id, query_id, entity, other_query, max(njs) AS hi, avg(njs) AS mid FROM {SCORED} GROUP BY ALL) GROUP BY ALL""")
def coherence_two_level(spark, d):
    out = co.two_level(scored(spark, d), "njs")
    return out.select("doc_id", "query_id", "entity", *(F.round(c, 6).alias(c) for c in out.columns[3:]))


TOP3 = ", ".join(f"coalesce(round(max({c}) FILTER (r_{c} = {j}), 6), 0) AS {c}_top{j}" for c in ("ngd", "njs") for j in (1, 2, 3))


@query(f"""SELECT doc_id, query_id, entity, {TOP3}
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id, entity ORDER BY ngd DESC) AS r_ngd, row_number() OVER (PARTITION BY doc_id, query_id, entity ORDER BY njs DESC) AS r_njs FROM (SELECT doc_id, query_id, entity, other_query, max(ngd) AS ngd, max(njs) AS njs FROM {SCORED} GROUP BY ALL)) GROUP BY ALL""")
def coherence_top3(spark, d):
    out = co.top_three(scored(spark, d), "ngd", "njs")
    return out.select("doc_id", "query_id", "entity", *(F.round(c, 6).alias(c) for c in out.columns[3:]))


NAMES = "(SELECT p_partkey, regexp_replace(trim(split_part(lower(p_type), '(', 1)), '[^a-zA-Z0-9_]+', '_', 'g') AS m, trim(regexp_replace(lower(p_type || '_' || p_name), '[_(). ,/'']+', ' ', 'g')) AS e, regexp_replace(trim(split_part(lower(p_type || '_' || p_name), '(', 1)), '[^a-zA-Z0-9_]+', '_', 'g') AS f, p_name AS n FROM part)"


def names(spark, d):
    mention, entity = tx.normalize_mention(F.col("p_type")), tx.normalize_entity(F.concat_ws("_", "p_type", "p_name"))
    return parquet(spark, d, "part").select("p_partkey", mention.alias("m"), entity.alias("e"), tx.normalize_mention(F.concat_ws("_", "p_type", "p_name")).alias("f"), F.col("p_name").alias("n"))


@query(f"""SELECT p_partkey, CASE WHEN length(m) <= length(f) THEN round(1 - levenshtein(m, f) / greatest(length(m), length(f)), 6) ELSE 0 END AS es, CASE WHEN length(m) <= length(f) THEN round(jaro_winkler_similarity(m, f), 6) ELSE 0 END AS jaro_winkler,
    (length(m) <= length(f) AND starts_with(f, m))::DOUBLE AS start_with, (length(m) <= length(f) AND suffix(f, m))::DOUBLE AS end_with, (m = f)::DOUBLE AS same FROM {NAMES}""")
def string_sim(spark, d):
    found = sim.string_features(F.col("m"), F.col("f"))
    return names(spark, d).select("p_partkey", *(F.round(c, 6).alias(k) for k, c in found.items()))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS jw, round(jaro_similarity(a.n_name, b.n_name), 6) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def jaro_winkler(spark, d):
    n = parquet(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", F.round(sim.jaro_winkler("x", "y"), 6).alias("jw"), F.round(sim.jaro("x", "y"), 6).alias("j"))


@query(f"""WITH x AS (SELECT p_partkey, string_split(e, ' ') AS a, string_split(n, ' ') AS b FROM {NAMES}), y AS (SELECT *, len(list_filter(a, lambda w: list_contains(b, w))) AS c, len(list_distinct(a)) AS da, len(list_distinct(list_concat(a, b))) AS u, len(list_intersect(a, b)) AS i FROM x)
    SELECT p_partkey, round(i / u, 6) AS jaccard, round(c / sqrt(len(a) * len(b)), 6) AS cosine, round(2 * c / (len(a) + len(b)), 6) AS dice, round(c / greatest(len(a), len(b)), 6) AS overlap FROM y""")
def token_sim(spark, d):
    e, n = F.col("e"), F.col("n")
    return names(spark, d).select("p_partkey", F.round(sim.token_jaccard(e, n), 6).alias("jaccard"), F.round(sim.token_cosine(e, n), 6).alias("cosine"), F.round(sim.token_dice(e, n), 6).alias("dice"), F.round(sim.token_overlap(e, n), 6).alias("overlap"))


@query(f"SELECT p_partkey, m, e, CASE WHEN length(n) < 4 THEN n ELSE upper(n) END AS form FROM {NAMES}")
def normalize_mention(spark, d):
    return names(spark, d).select("p_partkey", "m", "e", tx.normalize_form(F.col("n")).alias("form"))


@query(r"""SELECT p_partkey, CASE WHEN x = upper(x) THEN array_to_string(list_transform(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+'), lambda w: upper(w[1]) || w[2:]), ' ') ELSE x END AS fixed
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type || '. ' || p_name) ELSE p_name || ' ' || p_type END AS x FROM part)""")
def case_phrase_fix(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_type", F.lit(". "), "p_name"))).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    return parquet(spark, d, "part").select("p_partkey", tx.fix_upper_case(x).alias("fixed"))


@query("SELECT doc_id, md5(text) AS key FROM documents")
def md5_text(spark, d):
    return parquet(spark, d, "documents").select("doc_id", tx.text_key(F.col("text")).alias("key"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(array_to_string(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), chr(10)), '<[^>]*>', '', 'g'), '\[([0-9]+)\]', '', 'g') AS text FROM pages""")
def html_paragraphs(spark, d):
    return parquet(spark, d, "pages").select("page_id", tx.html_paragraphs(F.col("html")).alias("text"))


@query("SELECT doc_id, trim(replace(replace(replace(replace(text, '-' || chr(10), '-'), chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), '.' || chr(10) || chr(10)), ' ') AS text FROM documents")
def reflow_text(spark, d):
    return parquet(spark, d, "documents").select("doc_id", tx.reflow(F.col("text")).alias("text"))


@query("SELECT page_id, 'en.wikipedia.org/wiki/' || page_id AS long_id, replace('en.wikipedia.org/wiki/' || page_id, 'en.wikipedia.org/wiki/', '') AS short_id FROM pages")
def entity_prefix(spark, d):
    long_id = tx.add_prefix(F.col("page_id").cast("string"))
    return parquet(spark, d, "pages").select("page_id", long_id.alias("long_id"), tx.strip_prefix(long_id).alias("short_id"))


@query("""WITH l AS (SELECT l_suppkey AS doc, l_orderkey AS phrase, p_size AS token, l_linenumber AS pos, l_quantity AS w, l_returnflag AS f FROM lineitem JOIN part ON p_partkey = l_partkey),
    e AS (SELECT * FROM l WHERE f = 'A'), m AS (SELECT * FROM l WHERE f = 'R'), t AS (SELECT doc, phrase, sum(w) AS total FROM e GROUP BY ALL),
    p AS (SELECT e.doc, e.phrase AS ep, m.phrase AS mp, count(DISTINCT e.token) AS matches, max(m.pos) - min(m.pos) + 1 AS cover, sum(e.w) AS matched FROM e JOIN m ON e.doc = m.doc AND e.token = m.token GROUP BY ALL),
    b AS (SELECT p.doc, ep, max(total * matches / cover * power(matched / total, 2)) AS best, count(*) AS n FROM p JOIN t ON t.doc = p.doc AND t.phrase = ep GROUP BY ALL)
    SELECT doc, round(sum(best), 3) AS similarity, sum(n)::BIGINT AS n_matches, round(max(best), 6) AS highest FROM b GROUP BY doc""")
def phrase_similarity(spark, d):
    lines = parquet(spark, d, "lineitem").join(parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("token")), "l_partkey")
    lines = lines.select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("phrase"), "token", F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("weight"), "l_returnflag")
    out = co.phrase_similarity(lines.where("l_returnflag = 'A'").drop("pos", "l_returnflag").withColumn("pos", F.lit(0)), lines.where("l_returnflag = 'R'").drop("weight", "l_returnflag"), ["doc"])
    return out.select("doc", F.round("similarity", 3).alias("similarity"), "n_matches", F.round("highest", 6).alias("highest"))


@query("SELECT p_partkey, round(1 - hamming(rpad(p_name, n, chr(1)), rpad(p_type, n, chr(2))) / n, 6) AS hamming FROM (SELECT *, greatest(length(p_name), length(p_type))::INTEGER AS n FROM part)")
def hamming_sim(spark, d):
    part = parquet(spark, d, "part")
    return part.select("p_partkey", F.round(sim.hamming_similarity(F.col("p_name"), F.col("p_type")), 6).alias("hamming"))


@query("SELECT d.doc_id, substr(coalesce(nullif(b.text, ''), nullif(d.text, '')), 1, 1000000) AS article FROM documents d LEFT JOIN benchmark b ON item_id = doc_id")
def first_article(spark, d):
    other = parquet(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    return parquet(spark, d, "documents").select("doc_id", "text").join(other, "doc_id", "left").select("doc_id", tx.first_article(F.col("other"), F.col("text")).alias("article"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS sentence, l_partkey % 10 AS start, l_suppkey % 5 AS chain, l_shipdate::DATE::VARCHAR AS text, l_quantity > 25 AS r FROM lineitem WHERE l_returnflag = 'R'),
    f AS (SELECT doc_id, sentence, start, min(chain) AS chain FROM c GROUP BY ALL), p AS (SELECT doc_id, chain, min(text) AS text FROM c WHERE r GROUP BY ALL),
    t AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS sentence, l_partkey % 10 AS start, l_linestatus AS word FROM lineitem)
    SELECT t.doc_id, t.sentence, t.start, word, coalesce(chain, -1) AS chain, coalesce(text, word) AS text FROM t LEFT JOIN f USING (doc_id, sentence, start) LEFT JOIN p USING (doc_id, chain)""")
def representative_mention(spark, d):
    lines = parquet(spark, d, "lineitem")
    base = [F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sentence"), (F.col("l_partkey") % 10).alias("start")]
    chains = lines.where("l_returnflag = 'R'").select(*base, (F.col("l_suppkey") % 5).alias("chain"), F.to_date("l_shipdate").cast("string").alias("text"), (F.col("l_quantity") > 25).alias("is_representative"))
    tokens = lines.select(*base, F.col("l_linestatus").alias("word")).distinct()
    return mn.representative(tokens, chains)


@query("SELECT event_id, regexp_extract_all(props, '([.0-9]+)', 1)[1] AS first_number FROM events")
def log_numbers(spark, d):
    return parquet(spark, d, "events").select("event_id", F.try_element_at(tx.log_numbers(F.col("props")), F.lit(1)).alias("first_number"))


@query(r"""SELECT page_id, replace(regexp_replace(regexp_replace(x, '={2,}[\p{L}\p{N}_ |:–]+={2,}', '', 'g'), '/[^\n]*[\x{0250}-\x{02FF}][^\n]*/', '', 'g'), repeat(chr(10), 3), chr(10)) AS text
    FROM (SELECT page_id, '== ' || split_part(url, '/', 3) || ' ==' || repeat(chr(10), 3) || CASE WHEN page_id % 2 = 0 THEN '/pa' || chr(601) || '/ ' ELSE '/path/ ' END || html AS x FROM pages)""")
def strip_markup(spark, d):
    # A heading (with a dot in it on some pages, which stays), then slashes around a phonetic letter or a plain path.
    head = F.concat(F.lit("== "), F.split_part("url", F.lit("/"), F.lit(3)), F.lit(" ==\n\n\n"), F.when(F.col("page_id") % 2 == 0, "/pa\u0259/ ").otherwise("/path/ "))
    return parquet(spark, d, "pages").select("page_id", tx.strip_markup(F.concat(head, "html")).alias("text"))


@query("SELECT doc_id, md5(string_agg(cell, '|' ORDER BY token)) AS line FROM (SELECT doc_id, token, token || ':' || n AS cell FROM (SELECT doc_id, token, count(*) AS n FROM " + PLACED + " GROUP BY doc_id, token)) GROUP BY doc_id")
def token_line(spark, d):
    n = tk.exploded(docs(spark, d), "doc_id").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("token", "n"))), lambda x: F.concat_ws(":", x["token"], x["n"]))
    return n.groupBy("doc_id").agg(F.md5(F.array_join(cells, "|").cast("binary")).alias("line"))
