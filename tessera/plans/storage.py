"""Sinks and what is read back from them; each query writes to a folder of its own and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import matrix as mx
from tessera.operators import tokens as tk
from tessera.plans.registry import query
from tessera.plans.views import CANDIDATES, candidates
from tessera.sources import readers, writers
from tessera.sources.commits import CommitLog
from tessera.sources.commits import append_once as commit_once
from tessera.sources.readers import parquet
from tessera.sources.workspace import fresh_path

RANKED = f"(SELECT o_custkey AS doc_id, query_id, entity, prior, pos AS rank, label FROM {CANDIDATES} JOIN orders ON query_id = o_orderkey)"


def ranked(spark, d):
    docs = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("doc_id"))
    return candidates(spark, d).join(docs, "query_id").select("doc_id", "query_id", "entity", F.col("prior").alias("score"), F.col("pos").alias("rank"), "label")


@query("SELECT l_orderkey AS query_id, l_partkey AS entity, l_quantity AS f FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def feature_partition(spark, d):
    rows = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("entity"), F.col("l_quantity").alias("f"), F.lit("base").alias("exp"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("kind"))
    path = fresh_path(spark)
    writers.append(rows, path, "exp", "source", "kind")
    return readers.feature_rows(spark, path, "base", "A", "F").select("query_id", "entity", "f")


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey")
def append_and_mark(spark, d):
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    rows, done = fresh_path(spark), fresh_path(spark)
    writers.append_processed(orders.where("o_orderstatus = 'F'"), rows, done, "o_orderkey", "o_orderstatus")
    # The second run sees all orders and works on those that are not marked.
    left = orders.join(spark.read.parquet(done), "o_orderkey", "left_anti")
    writers.append_processed(left, rows, done, "o_orderkey", "o_orderstatus")
    return spark.read.parquet(rows).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderkey, o_orderstatus")
def append_once(spark, d):
    """Rows and marks in one commit: a first writer takes the finished orders, a second all that are left."""
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    log = CommitLog(spark, fresh_path(spark))
    kind = f"o_orderkey {orders.schema['o_orderkey'].dataType.simpleString()}, o_orderstatus string"
    for part in (orders.where("o_orderstatus = 'F'"), orders):
        commit_once(log, lambda marks, part=part: part.join(marks, "o_orderkey", "left_anti"), "o_orderkey", kind)
    return log.read("rows", kind).groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN p_name ELSE p_type END AS value FROM part")
def put_values(spark, d):
    part = parquet(spark, d, "part")
    path, target = fresh_path(spark), fresh_path(spark)
    writers.bulk_load(part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("value")), path, 10_000)
    writers.put(part.where("p_size > 25").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), path, ["key"], target)
    return spark.read.parquet(target)


@query("SELECT p_partkey AS key, p_type AS value FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size <= 25")
def put_if_absent(spark, d):
    part = parquet(spark, d, "part")
    path = fresh_path(spark)
    writers.put_if_absent(part.where("p_size > 25").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("value")), path, ["key"])
    writers.put_if_absent(part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")), path, ["key"])
    return spark.read.parquet(path)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'done' ELSE o_orderstatus END AS status FROM orders WHERE o_orderpriority <> '1-URGENT'")
def update_delete(spark, d):
    orders = parquet(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    left = writers.without(writers.updated(orders, F.col("status") == "O", "status", F.lit("done")), F.col("o_orderpriority") == "1-URGENT")
    path = fresh_path(spark)
    writers.append(left.select("o_orderkey", "status"), path)
    return spark.read.parquet(path)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    path = fresh_path(spark)
    writers.csv_export(parquet(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", header=True)


@query("SELECT item_id, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def article_batch(spark, d):
    wanted = parquet(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("item_id"))
    path = fresh_path(spark)
    writers.json_export(readers.by_ids(parquet(spark, d, "benchmark"), wanted, "item_id"), path)
    return spark.read.schema("item_id bigint, text string").json(path)


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def json_by_key(spark, d):
    path = fresh_path(spark)
    writers.json_export(parquet(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, by="n_regionkey")
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5")
def copy_dataset(spark, d):
    rows = parquet(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    source, target = fresh_path(spark), fresh_path(spark)
    writers.append(rows.where("c_nationkey < 5").select("c_custkey", "c_name"), source)
    writers.append(rows.select("c_custkey", "c_name"), target)
    writers.copy(spark, source, target)
    return spark.read.parquet(target)


@query(f"SELECT doc_id, query_id, rank, entity, prior AS score FROM {RANKED} WHERE rank <= 2")
def publish_predictions(spark, d):
    path = fresh_path(spark)
    writers.publish_predictions(ranked(spark, d), path, 2)
    return spark.read.parquet(path)


@query(f"SELECT doc_id, '[' || string_agg('{{\"query_id\":' || query_id || ',\"rank\":' || rank || ',\"entity\":' || entity || '}}', ',' ORDER BY query_id, rank) || ']' AS predictions FROM {RANKED} WHERE rank <= 2 GROUP BY doc_id")
def predictions_by_document(spark, d):
    return writers.predictions_by_document(ranked(spark, d), 2)


@query(f"SELECT query_id, '[' || string_agg('{{\"entity\":' || entity || ',\"score\":' || rank || '}}', ',' ORDER BY rank) || ']' AS filter FROM {RANKED} WHERE rank <= 3 GROUP BY query_id")
def predictions_by_mention(spark, d):
    return writers.predictions_by_mention(ranked(spark, d).withColumn("score", F.col("rank")), 3)


@query(f"SELECT doc_id, query_id, 1 AS rank, entity, prior AS score FROM {RANKED} WHERE label = 1")
def gold_as_prediction(spark, d):
    return writers.gold_predictions(ranked(spark, d))


@query("SELECT count(DISTINCT l_orderkey) FILTER (l_linestatus = 'F') AS done, count(DISTINCT o_orderkey) AS total, round(100.0 * count(DISTINCT l_orderkey) FILTER (l_linestatus = 'F') / count(DISTINCT o_orderkey), 6) AS percent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def run_status(spark, d):
    done = parquet(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("key"))
    return writers.run_status(done, parquet(spark, d, "orders").select(F.col("o_orderkey").alias("key")), "key").withColumn("percent", F.round("percent", 6))


@query("SELECT n_nationkey, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' AS html FROM nation")
def html_report(spark, d):
    return writers.html_table(parquet(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""WITH l AS (SELECT l_suppkey AS key, l_returnflag AS r, l_linestatus AS c, count(*) AS v FROM lineitem GROUP BY ALL), x AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY r) AS i, dense_rank() OVER (PARTITION BY key ORDER BY c) AS j FROM l)
    SELECT key, '{"hcrow":[' || string_agg(DISTINCT '"' || r || '"', ',' ORDER BY '"' || r || '"') || '],"hccol":[' || string_agg(DISTINCT '"' || c || '"', ',' ORDER BY '"' || c || '"') || '],"data":['
    || string_agg('{"row":' || i || ',"col":' || j || ',"value":' || v || '}', ',' ORDER BY i, j) || '],"max_value":' || max(v) || ',"min_value":' || min(v) || '}' AS json FROM x GROUP BY key""")
def json_matrix(spark, d):
    cells = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("row"), F.col("l_linestatus").alias("col")).agg(F.count("*").alias("value"))
    return mx.labelled_json(cells, "key")


@query("SELECT conv_id, count(*) AS n_cells, max(value)::BIGINT AS highest FROM (SELECT a.conv_id, a.n * b.n AS value FROM (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'user') GROUP BY ALL) a JOIN (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'assistant') GROUP BY ALL) b USING (conv_id, token)) GROUP BY conv_id")
def matrix_max(spark, d):
    return tk.matrix_max(tk.filled_cells(*_sides(spark, d), ["conv_id"]), ["conv_id"])


def _sides(spark, d):
    """Token counts of the users' turns, and of each of the assistant's."""
    n = tk.exploded(parquet(spark, d, "conversations").select("conv_id", F.col("turn").alias("entity"), "role", "text"), "conv_id", "entity", "role")
    mention = n.where("role = 'user'").groupBy("conv_id", "token").agg(F.count("*").alias("n"))
    return mention, n.where("role = 'assistant'").groupBy("conv_id", "entity", "token").agg(F.count("*").alias("n"))


SIDES = """a AS MATERIALIZED (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'user') GROUP BY ALL),
    b AS MATERIALIZED (SELECT conv_id, turn AS entity, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM conversations WHERE role = 'assistant') GROUP BY ALL),
    r AS MATERIALIZED (SELECT conv_id, token, row_number() OVER (PARTITION BY conv_id ORDER BY token) - 1 AS r FROM a), c AS MATERIALIZED (SELECT conv_id, entity, row_number() OVER (PARTITION BY conv_id ORDER BY entity) - 1 AS c FROM (SELECT DISTINCT conv_id, entity FROM b)),
    cells AS MATERIALIZED (SELECT conv_id, token, entity, a.n * b.n AS value FROM a JOIN b USING (conv_id, token))"""


@query(f"WITH {SIDES} SELECT conv_id, (r // 8)::INTEGER AS block_row, (c // 8)::INTEGER AS block_col, string_agg((r % 8) || ':' || (c % 8) || ':' || value, ',' ORDER BY r, c) AS cells FROM cells JOIN r USING (conv_id, token) JOIN c USING (conv_id, entity) GROUP BY conv_id, r // 8, c // 8")
def matrix_blocks(spark, d):
    """A matrix of tokens by turns for each conversation, stored as blocks of eight by eight that hold filled cells only."""
    mention, entity = _sides(spark, d)
    rows, cols = tk.axes(mention, entity, ["conv_id"])
    path = fresh_path(spark)
    writers.append(tk.blocked(tk.filled_cells(mention, entity, ["conv_id"]), rows, cols, ["conv_id"], 8), path)
    text = F.array_join(F.transform("cells", lambda x: F.concat_ws(":", x["r"].cast("string"), x["c"].cast("string"), x["value"].cast("string"))), ",")
    return spark.read.parquet(path).select("conv_id", "block_row", "block_col", text.alias("cells"))


@query(f"WITH {SIDES} SELECT conv_id, token, '[' || string_agg(coalesce(value, 0)::VARCHAR, ',' ORDER BY c) || ']' AS line FROM r JOIN c USING (conv_id) LEFT JOIN cells USING (conv_id, token, entity) GROUP BY conv_id, token")
def matrix_lines(spark, d):
    """The same matrices written out, zeros and all."""
    mention, entity = _sides(spark, d)
    rows, cols = tk.axes(mention, entity, ["conv_id"])
    return tk.dense_lines(tk.filled_cells(mention, entity, ["conv_id"]), rows, cols, ["conv_id"])


@query("SELECT l_orderkey AS label, l_partkey::DOUBLE AS f0, l_quantity AS f1 FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 0")
def libsvm_rows(spark, d):
    lines = parquet(spark, d, "lineitem").where("l_linenumber = 1 and l_quantity > 0")
    path = fresh_path(spark)
    lines.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(" 1:"), F.col("l_partkey").cast("string"), F.lit(" 2:"), F.col("l_quantity").cast("string")).alias("value")).write.text(path)
    from pyspark.ml.functions import vector_to_array

    rows = readers.libsvm(spark, path, 2).select(F.col("label").cast("long").alias("label"), vector_to_array("features").alias("v"))
    return rows.select("label", F.col("v")[0].alias("f0"), F.col("v")[1].alias("f1"))


@query("SELECT p_partkey // 5 AS row, list(p_name ORDER BY p_partkey) AS cells FROM part GROUP BY ALL")
def table_shaper(spark, d):
    rows = parquet(spark, d, "part").select("p_partkey", "p_name")
    return readers.shaped(rows, ["p_partkey"], "p_name", 5)


@query("SELECT 'd' || p_brand AS doc_id, p_name AS surfaceform, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE replace(p_type, ' ', '_') END AS annotation, p_partkey::INTEGER AS begoffset, p_size AS length, 'Raw text of ' || p_brand AS text FROM part")
def xml_annotations(spark, d):
    part = parquet(spark, d, "part")
    path, texts = fresh_path(spark), parquet(spark, d, "part").select(F.concat(F.lit("d"), "p_brand").alias("doc_id"), F.concat(F.lit("Raw text of "), "p_brand").alias("text")).distinct()
    cell = F.concat(F.lit("<annotation><mention>"), "p_name", F.lit("</mention><wikiName>"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")), F.lit("</wikiName><offset>"), F.col("p_partkey").cast("string"), F.lit("</offset><length>"), F.col("p_size").cast("string"), F.lit("</length></annotation>"))
    docs = part.groupBy("p_brand").agg(F.concat(F.lit('<root><document docName="d'), F.first("p_brand"), F.lit('">'), F.array_join(F.collect_list(cell), ""), F.lit("</document></root>")).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.with_raw_text(readers.annotated_xml(spark, path), texts).select("doc_id", "surfaceform", "annotation", "begoffset", "length", "text")
