"""Token statistics of documents that share a group (the candidates of a query)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import tokens


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each token: ``keep``, token, position (from 0).

    An outer generator and a filter on its own rows: of a plain one Spark infers filters on the array,
    and would run the pattern for each of them again.
    """
    return docs.select(*keep, F.posexplode_outer(tokens(F.col("text"))).alias("pos", "token")).where("token is not null")


#: Documents in a task of those that make tokens: texts grow several times over as tokens.
DOCS_A_PART = 2000


def dealt(docs: DataFrame, doc: str) -> DataFrame:
    """``docs`` by document, in parts of about DOCS_A_PART rows however large the table, so that a task's memory stays."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCS_A_PART)
    return docs.repartition(parts, doc)


def _bounds(values: Column, key: Callable[[Column], Column]) -> Column:
    """(a, b) of each run of equal keys in a sorted array: its first place, from 1, and the place behind its last."""
    starts = F.filter(F.sequence(F.lit(1), F.size(values)), lambda i: (i == 1) | (key(F.get(values, i - 1)) != key(F.get(values, i - 2))))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(values) + 1))
    return F.arrays_zip(starts.alias("a"), ends.alias("b"))


def runs(values: Column) -> Column:
    """(token, n, total) of each distinct value of a sorted array: how long its run is, and the array; a null token if it is empty."""
    return F.transform(_bounds(values, lambda x: x), lambda x: F.struct(F.get(values, x["a"] - 1).alias("token"), (x["b"] - x["a"]).cast("long").alias("n"), F.size(values).cast("long").alias("total")))


def index(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, token, positions): each token's places in each document, in order.

    Tokens are sorted in their document's row: only texts are shuffled.  Rows of one document count together.
    """
    whole = dealt(docs.select(*keep, "text"), keep[0]).groupBy(*keep).agg(F.collect_list("text").alias("texts"))
    placed = F.flatten(F.transform("texts", lambda t: F.transform(tokens(t), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))))
    # One array of one array, so that it is made once though it is read many times.
    found = F.flatten(F.transform(F.array(F.sort_array(placed)), lambda v: F.transform(_bounds(v, lambda x: x["token"]), lambda x: F.struct(F.get(v, x["a"] - 1)["token"].alias("token"), F.transform(F.slice(v, x["a"], x["b"] - x["a"]), lambda y: y["pos"]).alias("positions")))))
    return whole.select(*keep, F.explode_outer(found).alias("r")).where("r.token is not null").select(*keep, "r.token", "r.positions")


def counts(docs: DataFrame, group: list[str], doc: str) -> DataFrame:
    """group, doc, token, n, total: how often a token stands in a document, and the document's tokens.

    Texts are dealt by document before they become tokens, so that a file
    of few row groups is worked on by all cores; tokens are sorted and counted in their document's row, with
    neither a shuffle nor a table of a task's tokens.  A plan that reads the counts twice or more had better store them.
    """
    # Rows of one document count together; a line break ends a token.
    whole = dealt(docs.select(*group, doc, "text"), doc).groupBy(*group, doc).agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    # One array of one array, so that it is made once though it is read many times.
    found = F.flatten(F.transform(F.array(F.sort_array(tokens(F.col("text")))), runs))
    rows = whole.select(*group, doc, F.explode_outer(found).alias("r")).where("r.token is not null")
    return rows.select(*group, doc, "r.token", "r.n", "r.total")


def term_frequency(token_counts: DataFrame, group: list[str], doc: str) -> DataFrame:
    """tf: a token's share of its document's tokens."""
    return token_counts.select(*group, doc, "token", "n", (F.col("n") / F.col("total")).alias("tf"))


def spread(token_counts: DataFrame, docs: DataFrame, group: list[str], normalized: bool = True) -> DataFrame:
    """df, idf (log10 of documents by df) and the entropy of frequencies, the documents without the token included.

    Two aggregations, the first with partial sums: documents by frequency, then the buckets.
    """
    size = docs.groupBy(*group).agg(F.count("*").alias("size"))
    buckets = token_counts.groupBy(*group, "token", "n").agg(F.count("*").alias("c")).join(size, group)
    p = F.col("c") / F.col("size")
    by_token = buckets.groupBy(*group, "token").agg(F.sum("c").alias("df"), F.max("size").alias("size"), F.sum(-p * F.log10(p)).alias("h"), F.count("*").alias("k"))
    rest = (F.col("size") - F.col("df")) / F.col("size")
    h = F.col("h") + F.when(rest > 0, -rest * F.log10(F.when(rest > 0, rest).otherwise(1.0))).otherwise(0.0)
    k = F.col("k") + (rest > 0).cast("int")
    entropy = F.when(k > 1, h / F.log10(F.greatest(k, F.lit(2)))).otherwise(h) if normalized else h
    return by_token.select(*group, "token", "df", F.log10(F.col("size") / F.col("df")).alias("idf"), entropy.alias("entropy"))


def shared_counts(token_counts: DataFrame, mention: DataFrame, keys: list[str]) -> DataFrame:
    """The counts of tokens that a mention's context has: all that overlap statistics read, and frequencies of."""
    return token_counts.join(mention.select(*keys, "token"), [*keys, "token"], "left_semi")


def overlap_statistics(mention: DataFrame, entity_tf: DataFrame, stats: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Eleven statistics over tokens that a mention's context shares with a candidate.

    ``mention``: keys, token, w (times in the context); ``entity_tf``: keys, entity, token, tf;
    ``stats``: keys, token, idf, entropy.
    """
    rows = mention.join(entity_tf, [*keys, "token"]).join(stats, [*keys, "token"])
    w, tf, idf, h = (F.col(c) for c in ("w", "tf", "idf", "entropy"))
    return rows.groupBy(*keys, entity).agg(
        F.sum(h).alias("etp_sum"), F.sum(h * w).alias("w_etp_sum"), F.min(h).alias("min_etp"),
        F.sum(idf).alias("idf_sum"), F.sum(idf * w).alias("w_idf_sum"), F.max(idf).alias("max_idf"),
        F.sum(tf * idf).alias("tf_idf_sum"), F.sum(tf * idf * w).alias("w_tf_idf_sum"), F.max(tf * idf).alias("max_tf_idf"),
        F.sum(tf * idf * h).alias("tf_idf_entropy_sum"), F.sum(tf * h).alias("tf_entropy_sum"),
    )


def idf_entropy_mix(rows: DataFrame, keys: list[str], weights: tuple[float, ...] = (0.1, 0.5, 0.9, 1.5, 1.9)) -> DataFrame:
    """Sums of (w * scaled idf + (1 - w) * entropy) * tf, idf scaled over the group's rows."""
    win = Window.partitionBy(*keys)
    low, high = F.min("idf").over(win), F.max("idf").over(win)
    scaled = rows.withColumn("idf_s", F.coalesce(F.try_divide(F.col("idf") - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0)))
    return scaled.groupBy(*keys).agg(*(F.sum((w * F.col("idf_s") + (1 - w) * F.col("entropy")) * F.col("tf")).alias(f"mix_{str(w).replace('.', '_')}") for w in weights))


def older_statistics(mention: DataFrame, entity_tf: DataFrame, stats: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The earlier twelve statistics: sums, weighted sums and maxima of entropy, idf, tf*idf and tf*entropy."""
    rows = mention.join(entity_tf, [*keys, "token"]).join(stats, [*keys, "token"])
    w, tf, idf, h = (F.col(c) for c in ("w", "tf", "idf", "entropy"))
    found = {"etp": h, "idf": idf, "tf_idf": tf * idf, "tf_entropy": tf * h}
    out = []
    for name, x in found.items():
        out += [F.sum(x).alias(f"{name}_sum"), F.sum(x * w).alias(f"w_{name}_sum"), F.greatest(F.max(x), F.lit(0.0)).alias(f"max_{name}")]
    return rows.groupBy(*keys, entity).agg(*out)


def _marked(rows: DataFrame, stopwords: DataFrame, entities: DataFrame) -> DataFrame:
    """``rows`` with entity and start where an entity covers the token, stop where it is a stopword.

    Rows and entities dealt by document meet where they lie; for this the session's
    ``spark.sql.requireAllClusterKeysForCoPartition`` is set to false.
    """
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    inside = entities.select("doc_id", "entity", "start", F.explode(F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1))).alias("pos"))
    return rows.join(inside, ["doc_id", "pos"], "left").join(F.broadcast(stopwords.select("token", F.lit(True).alias("stop")).distinct()), "token", "left")


def meaningful(rows: DataFrame, stopwords: DataFrame, entities: DataFrame) -> DataFrame:
    """Tokens that are neither stopwords nor inside an entity, and each entity once, at its first token.

    ``rows``: doc_id, pos, token; ``stopwords``: token; ``entities``: doc_id, start, end (tokens, the
    end excluded), entity.
    """
    kept = F.when(F.col("entity").isNull(), F.col("stop").isNull()).otherwise(F.col("pos") == F.col("start"))
    return _marked(rows, stopwords, entities).where(kept).select("doc_id", "pos", F.coalesce("entity", "token").alias("token"))


def spliced(rows: DataFrame, stopwords: DataFrame, entities: DataFrame) -> DataFrame:
    """As ``meaningful``, but what follows a document's last entity keeps its stopwords."""
    last = entities.groupBy("doc_id").agg(F.max("end").alias("tail"))
    # No entity reaches beyond the last end, so that each token behind it is there once, in one reading of the rows.
    kept = F.when(F.col("entity").isNull(), F.col("stop").isNull() | (F.col("pos") >= F.coalesce("tail", F.lit(0)))).otherwise(F.col("pos") == F.col("start"))
    return _marked(rows, stopwords, entities).join(last, "doc_id", "left").where(kept).select("doc_id", "pos", F.coalesce("entity", "token").alias("token"))


def log2_tf_idf(token_counts: DataFrame, docs: DataFrame, group: list[str], doc: str) -> DataFrame:
    """tf * log2(documents / df)."""
    size = docs.groupBy(*group).agg(F.count("*").alias("size"))
    df = token_counts.groupBy(*group, "token").agg(F.count("*").alias("df")).join(F.broadcast(size), group)
    return token_counts.join(df, [*group, "token"]).select(*group, doc, "token", (F.col("n") / F.col("total") * F.log2(F.col("size") / F.col("df"))).alias("tf_idf"))


def token_weights(tokens_: DataFrame, idf: DataFrame, mi: DataFrame, occurrences: DataFrame, collection: int, default_mi: float = 0.001) -> DataFrame:
    """idf (log2 of the collection where unknown), mi (a default where unknown), log2(collection / (count + 1)).

    ``tokens_``: entity, token; ``idf``: token, idf; ``mi``: entity, token, mi; ``occurrences``: token, count.
    """
    out = tokens_.join(idf, "token", "left").join(mi, ["entity", "token"], "left").join(occurrences, "token", "left")
    size = F.lit(float(collection))
    return out.select("entity", "token", F.coalesce("idf", F.log2(size)).alias("idf"), F.coalesce("mi", F.lit(default_mi)).alias("mi"), F.log2(size / (F.coalesce("count", F.lit(0)) + 1)).alias("aida"))


def proximity(phrases: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(query_id, distance, phrase): 0 for phrases that hold the mention or stand in it, 1 for the others.

    ``phrases``: query_id, mention, tuple, phrase.  A tuple counts only if it has a phrase at 0.
    """
    m, p = F.lower("mention"), F.lower("phrase")
    rows = phrases.where(p != "null").join(stopwords.select(F.col("token").alias("low"), F.lit(True).alias("stop")), p == F.col("low"), "left")
    rows = rows.withColumn("distance", F.when(F.col("stop").isNull() & (F.contains(p, m) | F.contains(m, p)), 0).otherwise(1))
    near = rows.where("distance = 0").select("query_id", "tuple").distinct()
    return rows.join(near, ["query_id", "tuple"], "left_semi").select("query_id", "distance", "phrase").distinct()


def context_windows(docs: DataFrame, keep: list[str], targets: DataFrame, width: int) -> DataFrame:
    """Tokens up to ``width`` places around each occurrence of a target token, one row for each.

    Ranges meet by blocks of ``width`` places, an equi-join; the last token of a document does not count.
    """
    rows = exploded(docs, *keep)
    last = Window.partitionBy(*keep)
    rows = rows.withColumn("last", F.max("pos").over(last)).withColumn("block", F.floor(F.col("pos") / width))
    centres = rows.join(targets, "token", "left_semi").select(*keep, F.col("pos").alias("centre"), F.col("token").alias("target"), F.explode(F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))).alias("block"))
    near = rows.where("pos < last").join(centres, [*keep, "block"])
    return near.where((F.abs(F.col("pos") - F.col("centre")) <= width) & (F.col("pos") != F.col("centre"))).select(*keep, "target", "centre", "pos", "token")


def filled_cells(mention: DataFrame, entity: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, entity, value) of the cells where a token and an entity of one key meet: the product of their counts.

    ``mention``: keys, token, n; ``entity``: keys, entity, token, n.  Nothing is made for empty cells.
    """
    return mention.withColumnRenamed("n", "_a").join(entity.withColumnRenamed("n", "_b"), [*keys, "token"]).select(*keys, "token", "entity", (F.col("_a") * F.col("_b")).alias("value"))


def matrix_max(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How many cells of a matrix are filled, and its highest value, by key."""
    return cells.where("value > 0").groupBy(*keys).agg(F.count("*").alias("n_cells"), F.max("value").alias("highest"))


def axes(mention: DataFrame, entity: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, token, r) and (keys, entity, c): the places, from 0, of a matrix's rows and columns."""
    place = lambda df, column, name: df.select(*keys, column).distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(column)) - 1)
    return place(mention, "token", "r"), place(entity, "entity", "c")


def blocked(cells: DataFrame, rows: DataFrame, cols: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Filled cells as coordinate blocks (keys, block_row, block_col, cells) of ``size`` rows and columns at most; empty blocks are not there."""
    placed = cells.where("value <> 0").join(rows, [*keys, "token"]).join(cols, [*keys, "entity"])
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    inside = F.struct((F.col("r") % size).alias("r"), (F.col("c") % size).alias("c"), "value")
    return placed.groupBy(*keys, at("r").alias("block_row"), at("c").alias("block_col")).agg(F.sort_array(F.collect_list(inside)).alias("cells"))


def dense_lines(cells: DataFrame, rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, line): each row of a matrix as a JSON list, its zeros made only here."""
    width = cols.groupBy(*keys).agg(F.count("*").alias("width"))
    held = cells.join(cols, [*keys, "entity"]).groupBy(*keys, "token").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("held"))
    full = rows.join(width, keys).join(held, [*keys, "token"], "left")
    values = F.transform(F.sequence(F.lit(0), (F.col("width") - 1).cast("int")), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0).cast("long")))
    return full.select(*keys, "token", F.to_json(values).alias("line"))


def cooccurrence(mention: DataFrame, entity: DataFrame, keys: list[str]) -> DataFrame:
    """Dense cells (row token, column entity): product of the two counts, 0 where they do not meet.

    An export: what is stored or summed up had better be ``filled_cells``.  Rows and columns of one key only.
    """
    rows = mention.select(*keys, "token").distinct()
    cols = entity.select(*keys, "entity").distinct()
    filled = filled_cells(mention, entity, keys)
    return rows.join(cols, keys).join(filled, [*keys, "token", "entity"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
