"""Coherence of entities through a link graph, given as distinct edges (src, dst).

Pairs come from documents; each unordered pair is worked out once and joined back.  Shared sources are
found in the cheaper of two ways, by exact counts taken first: the links of asked entities meet at their
sources, or each pair is met from its end of fewer links, whose sources are looked up among the other's.
So never more rows are made than pairs are asked times their rarer end has links.  No adjacency list is
gathered and nothing is crossed.

Scores of all pairs of documents come another way where sources are cheap (``scored_documents``): a
document's pairs are made where the document is and never dealt anew.  Only what is asked goes out, an
entity with lists of the others, and only pairs that share a source come back.

The best and mean value for each candidate (``max_and_mean_of_others``) need no other pairs than those, as
all others are 0 and only have to be counted.  They are asked for in TURNS, so disk holds a part of them at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.similarity import ngd, njs, phrase_kernel, pmi
from tessera.operators.ranking import top_k
from tessera.sources.workspace import drop, stored

#: Pairs a task makes, entities in a list, and what one document or entity may add to one task.
PAIRS_A_PART, LIST, WIDEST = 1 << 20, 256, 1 << 22
#: More pairs than a task makes are asked for in so many turns.
TURNS = 4


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree of each entity; ``edges`` are distinct."""
    return edges.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("degree"))


def sized_pairs(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, degree_a, degree_b), 0 for entities without links."""
    size = degrees(edges)
    one = distinct.join(size.select(F.col("entity").alias("a"), F.col("degree").alias("degree_a")), "a", "left")
    return one.join(size.select(F.col("entity").alias("b"), F.col("degree").alias("degree_b")), "b", "left").fillna(0, ["degree_a", "degree_b"]).select("a", "b", "degree_a", "degree_b")


def rarer_sources(sized: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, degree_a, degree_b, other, src): each pair with every source of its end of fewer links, null if that has none."""
    rare = F.col("degree_a") <= F.col("degree_b")
    ends = sized.withColumn("rare", F.when(rare, F.col("a")).otherwise(F.col("b"))).withColumn("other", F.when(rare, F.col("b")).otherwise(F.col("a")))
    return ends.join(edges.select(F.col("dst").alias("rare"), "src"), "rare", "left").drop("rare")


def common_from_rarer(sized: DataFrame, edges: DataFrame) -> DataFrame:
    met = rarer_sources(sized, edges).join(edges.select("src", F.col("dst").alias("other"), F.lit(1).alias("met")), ["src", "other"], "left")
    return met.groupBy("a", "b").agg(F.count("met").alias("common"), F.max("degree_a").alias("degree_a"), F.max("degree_b").alias("degree_b"))


def common_at_sources(sized: DataFrame, near: DataFrame) -> DataFrame:
    one, two = near.select(F.col("dst").alias("a"), "src"), near.select(F.col("dst").alias("b"), "src")
    common = one.join(two, "src").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return sized.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"), "degree_a", "degree_b")


def document_pairs(candidates: DataFrame, others: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, query_id, entity, other_query, other): a candidate beside entities of other mentions.

    ``others`` has doc_id, query_id, entity and, where ``k`` is given, rank.
    """
    far = others if k is None else others.where(F.col("rank") <= k)
    far = far.select("doc_id", F.col("query_id").alias("other_query"), F.col("entity").alias("other"))
    near = candidates.select("doc_id", "query_id", "entity")
    return near.join(far, "doc_id").where((F.col("query_id") != F.col("other_query")) & (F.col("entity") != F.col("other")))


def pair_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """common, degree_a, degree_b for each distinct unordered pair (a < b) of ``pairs`` (entity, other).

    Pairs with their degrees are stored, as they are counted before they are joined; so are the links of asked entities, where all links would cost more.
    """
    distinct = pairs.select(F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b")).distinct()
    sized = stored(sized_pairs(distinct, edges))
    fan = F.col("n").cast("double")
    at_sources = lambda links: links.groupBy("src").agg(F.count("*").alias("n")).agg(F.sum(fan * (fan - 1) / 2)).first()[0] or 0.0
    from_rarer = sized.agg(F.sum(F.least("degree_a", "degree_b").cast("double"))).first()[0] or 0.0
    if at_sources(edges) <= from_rarer:
        return common_at_sources(sized, edges)
    # Links of entities that nobody asks for may be what makes sources dear.
    asked = sized.select(F.col("a").alias("dst")).union(sized.select("b")).distinct()
    near = stored(edges.select("src", "dst").join(asked, "dst", "left_semi"))
    return common_at_sources(sized, near) if at_sources(near) <= from_rarer else common_from_rarer(sized, near)


def similarities(links: DataFrame, universe: int) -> DataFrame:
    c, x, y = F.col("common"), F.col("degree_a"), F.col("degree_b")
    return links.select("a", "b", pmi(c, x, y, universe).alias("pmi"), ngd(c, x, y, universe).alias("ngd"), njs(c, x, y).alias("njs"))


def linked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether either entity links to the other, and whether both do."""
    e = edges.select("src", "dst")
    out = pairs.join(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("ab")), ["a", "b"], "left")
    out = out.join(e.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.lit(1).alias("ba")), ["a", "b"], "left")
    return out.withColumn("is_linked", F.col("ab").isNotNull() | F.col("ba").isNotNull()).withColumn("is_mutual", F.col("ab").isNotNull() & F.col("ba").isNotNull()).drop("ab", "ba")


def scored_pairs(pairs: DataFrame, edges: DataFrame, universe: int) -> DataFrame:
    """``pairs`` with pmi, ngd and njs."""
    sims = similarities(pair_links(pairs, edges), universe)
    keyed = pairs.withColumn("a", F.least("entity", "other")).withColumn("b", F.greatest("entity", "other"))
    return keyed.join(sims, ["a", "b"]).drop("a", "b")


def _asked(candidates: DataFrame, far: DataFrame, links: DataFrame, size: DataFrame) -> tuple[float, bool]:
    """How many pairs documents have, and whether sources are cheaper and no document or entity would fill a task."""
    count = lambda df, key, name: df.groupBy(key).agg(F.count("*").cast("double").alias(name))
    here = count(candidates, "doc_id", "n").join(count(far, "doc_id", "m"), "doc_id").agg(F.sum(F.col("n") * F.col("m")), F.max(F.col("n") * F.col("m"))).first()
    fan = F.col("n")
    sources = count(links, "src", "n").agg(F.sum(fan * (fan - 1) / 2), F.max(fan)).first()
    (asked, widest), (met, fullest), most = (x or 0.0 for x in here), (x or 0.0 for x in sources), size.agg(F.max("degree")).first()[0] or 0
    return asked, met <= asked and max(widest, most * fullest) <= WIDEST


def in_turns(key: str) -> list:
    """Conditions that each take another share of the keys."""
    return [F.pmod(F.xxhash64(key), F.lit(TURNS)) == t for t in range(TURNS)]


def scored_documents(candidates: DataFrame, others: DataFrame, edges: DataFrame, universe: int, k: int | None = None) -> DataFrame:
    """``document_pairs`` with pmi, ngd and njs, dealt by document.

    Both tables are read several times and had better be stored.  Entities that share no source score 0,
    so pairs are only told the sources they share.  Where links at their sources outnumber the pairs, or one
    document or entity would fill a task, the pairs are stored and scored by ``scored_pairs``.
    """
    both = others is candidates and k is None
    far = others if k is None else others.where(F.col("rank") <= k)
    links, size = edges.select("src", "dst"), stored(degrees(edges))
    asked, narrow = _asked(candidates, far, links, size)
    if not narrow:
        return scored_pairs(stored(document_pairs(candidates, others, k)), edges, universe)
    conf = candidates.sparkSession.conf
    # Rows that lie by document, or by entity, are joined there on more keys; without this Spark deals them anew.
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), int(asked // PAIRS_A_PART))
    sized = lambda df: df.select("doc_id", "query_id", "entity").join(size, "entity", "left").select("doc_id", "query_id", "entity", F.coalesce("degree", F.lit(0)).alias("degree")).repartition(parts, "doc_id")
    near = sized(candidates)
    far = near if both else sized(far)
    far = far.select("doc_id", F.col("query_id").alias("other_query"), F.col("entity").alias("other"), F.col("degree").alias("other_degree"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("entity"))
    lists = near.select("doc_id", "entity").distinct().withColumn("part", F.floor((nth - 1) / LIST)).groupBy("doc_id", "part").agg(F.collect_list("entity").alias("entities"))
    # Where both sides are the same, each unordered pair is asked once, at its greater end.
    wanted = (lambda e: e < F.col("other")) if both else (lambda e: e != F.col("other"))
    out = far.select("doc_id", "other").distinct().join(lists, "doc_id").select("doc_id", "other", F.filter("entities", wanted).alias("entities")).where(F.size("entities") > 0)
    out = out.repartition(parts, "other").select("doc_id", "other", F.explode("entities").alias("entity"))
    ends = links.select("src", F.col("dst").alias("other")).join(links.select("src", F.col("dst").alias("entity")), "src").where(wanted(F.col("entity")))
    common = ends.select("other", "entity").repartition(parts, "other").groupBy("other", "entity").agg(F.count("*").alias("common"))
    back = out.join(common.hint("shuffle_hash"), ["other", "entity"]).select(F.col("doc_id").alias("_doc"), F.col("other").alias("_other"), F.col("entity").alias("_entity"), "common").repartition(parts, "_doc")
    pairs = near.join(far, "doc_id").where((F.col("query_id") != F.col("other_query")) & (F.col("entity") != F.col("other")))
    high, low = (F.greatest("entity", "other"), F.least("entity", "other")) if both else (F.col("other"), F.col("entity"))
    found = pairs.join(back.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (high == F.col("_other")) & (low == F.col("_entity")), "left")
    c, x, y = F.coalesce("common", F.lit(0)), F.col("degree"), F.col("other_degree")
    return found.select("doc_id", "query_id", "entity", "other_query", "other", pmi(c, x, y, universe).alias("pmi"), ngd(c, x, y, universe).alias("ngd"), njs(c, x, y).alias("njs"))


def _met_in_documents(near: DataFrame, far: DataFrame, links: DataFrame, size: DataFrame, asked: float) -> list[DataFrame]:
    """(doc_id, other, entity, njs), stored: the pairs of documents that share a source; ``near`` and ``far`` are dealt by document.

    A document's entities and others are gathered once, in lists; each turn sends lists to its share of the others.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(name))
        return df.withColumn("part", F.floor((nth - 1) / LIST)).groupBy("doc_id", "part").agg(F.collect_list(name).alias(name)).drop("part")

    lists = stored(listed(near.select("doc_id", "entity").distinct(), "entity").join(listed(far.select("doc_id", "other").distinct(), "other"), "doc_id"))
    turns = in_turns("other") if asked > PAIRS_A_PART else [F.lit(True)]
    parts = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(asked // len(turns) // PAIRS_A_PART))
    found = []
    for mine in turns:
        out = lists.select("doc_id", "entity", F.explode("other").alias("other")).where(mine)
        out = out.select("doc_id", "other", F.filter("entity", lambda e: e != F.col("other")).alias("entity")).where(F.size("entity") > 0)
        out = out.repartition(parts, "other").select("doc_id", "other", F.explode("entity").alias("entity"))
        ends = links.select("src", F.col("dst").alias("other")).where(mine).join(links.select("src", F.col("dst").alias("entity")), "src").where("entity <> other")
        common = ends.select("other", "entity").repartition(parts, "other").groupBy("other", "entity").agg(F.count("*").alias("common"))
        met = out.join(common.hint("shuffle_hash"), ["other", "entity"]).join(size.select(F.col("entity").alias("other"), F.col("degree").alias("other_degree")), "other").join(size, "entity")
        found.append(stored(met.select("doc_id", "other", "entity", njs(F.col("common"), F.col("degree"), F.col("other_degree")).alias("njs"))))
    drop(lists)
    return found


def max_and_mean_of_others(candidates: DataFrame, others: DataFrame, edges: DataFrame, universe: int, k: int) -> DataFrame:
    """(doc_id, query_id, entity, coherence_max, coherence_mean): ``max_max`` and ``avg_max`` of njs as by ``two_level`` over ``scored_documents``.

    Both tables are read several times and had better be stored.  Rows whose values are 0 may be left out: pairs
    that share no source are only counted, a document's other mentions without those that have but this entity.
    """
    far = others.where(F.col("rank") <= k)
    links, size = edges.select("src", "dst"), stored(degrees(edges))
    asked, narrow = _asked(candidates, far, links, size)
    if not narrow:
        scored = two_level(scored_documents(candidates, others, edges, universe, k), "njs")
        return scored.select("doc_id", "query_id", "entity", F.col("max_max").alias("coherence_max"), F.col("avg_max").alias("coherence_mean"))
    conf = candidates.sparkSession.conf
    # All that follows lies by document, and is joined and grouped there on more keys.
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), int(asked // PAIRS_A_PART))
    near = candidates.select("doc_id", "query_id", "entity").dropna().repartition(parts, "doc_id")
    far = far.select("doc_id", F.col("query_id").alias("other_query"), F.col("entity").alias("other")).dropna().repartition(parts, "doc_id")
    met = reduce(DataFrame.union, _met_in_documents(near, far, links, size, asked)).repartition(parts, "doc_id")
    pairs = met.join(far, ["doc_id", "other"]).join(near, ["doc_id", "entity"]).where("query_id <> other_query")
    best = pairs.groupBy("doc_id", "query_id", "entity", "other_query").agg(F.max("njs").alias("hi"))
    best = best.groupBy("doc_id", "query_id", "entity").agg(F.max("hi").alias("hi"), F.sum("hi").alias("total"))
    own = far.groupBy("doc_id", F.col("other_query").alias("query_id")).agg(F.min("other").alias("low"), F.max("other").alias("high"))
    own = own.select("doc_id", "query_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"), F.lit(1).alias("own"))
    mentions = own.groupBy("doc_id").agg(F.count("*").alias("mentions"))
    alike = own.where("only is not null").groupBy("doc_id", F.col("only").alias("entity")).agg(F.count("*").alias("alike"))
    best = best.join(own, ["doc_id", "query_id"], "left").join(mentions, "doc_id").join(alike, ["doc_id", "entity"], "left")
    # The mention itself is taken out once, be it among those that have but this entity or not.
    itself = F.when(F.col("only") == F.col("entity"), F.lit(0)).otherwise(F.coalesce("own", F.lit(0)))
    n = F.col("mentions") - F.coalesce("alike", F.lit(0)) - itself
    return best.select("doc_id", "query_id", "entity", F.col("hi").alias("coherence_max"), (F.col("total") / n).alias("coherence_mean"))


def max_and_mean(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Over distinct other entities: the highest value, and the sum over all of them by their number."""
    once = scored.groupBy("doc_id", "query_id", "entity", "other").agg(*(F.max(c).alias(c) for c in columns))
    return once.groupBy("doc_id", "query_id", "entity").agg(*(F.max(c).alias(f"max_{c}") for c in columns), *((F.sum(c) / F.count("*")).alias(f"avg_{c}") for c in columns))


def two_level(scored: DataFrame, column: str) -> DataFrame:
    """Best or mean for each other mention, then best or mean of those."""
    inner = scored.groupBy("doc_id", "query_id", "entity", "other_query").agg(F.max(column).alias("hi"), F.avg(column).alias("mid"))
    return inner.groupBy("doc_id", "query_id", "entity").agg(F.max("hi").alias("max_max"), F.avg("hi").alias("avg_max"), F.max("mid").alias("max_avg"), F.avg("mid").alias("avg_avg"))


def top_three(scored: DataFrame, *columns: str) -> DataFrame:
    """For each column the three best of the other mentions' best values, 0 where there are fewer."""
    keys = ["doc_id", "query_id", "entity"]
    inner = scored.groupBy(*keys, "other_query").agg(*(F.max(c).alias(c) for c in columns))
    # The window keeps three rows a group before the shuffle, whatever the group's size.
    each = inner.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in columns))).alias("v")).select(*keys, "v.name", "v.x")
    best = top_k(each, [*keys, "name"], [F.desc("x")], 3)
    at = lambda c, j: F.coalesce(F.max(F.when((F.col("name") == c) & (F.col("rank") == j), F.col("x"))), F.lit(0.0))
    return best.groupBy(*keys).agg(*(at(c, j).alias(f"top{j}" if len(columns) == 1 else f"{c}_top{j}") for c in columns for j in (1, 2, 3)))


#: Rows of phrases in a task: their pairs are several times as many.
PHRASE_ROWS_A_PART = 1 << 17


def phrase_similarity(entity: DataFrame, mention: DataFrame, keys: list[str]) -> DataFrame:
    """Best weight of each entity phrase over the mention's phrases, driven by shared tokens, then summed.

    Both: keys, phrase, token, pos, weight.  Phrases that share no token weigh 0 and never meet.
    """
    rows = entity.count() + mention.count()
    # Rows of equal keys are dealt out once, and everything after that is done where they lie.
    if rows > PHRASE_ROWS_A_PART:
        entity.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        parts = max(int(entity.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // PHRASE_ROWS_A_PART)
        entity, mention = entity.repartition(parts, *keys), mention.repartition(parts, *keys)
    e = entity.withColumnRenamed("phrase", "e_phrase").withColumnRenamed("pos", "e_pos").withColumnRenamed("weight", "e_weight")
    totals = e.groupBy(*keys, "e_phrase").agg(F.sum("e_weight").alias("total"))
    met = e.join(mention.select(*keys, F.col("phrase").alias("m_phrase"), "token", "pos"), [*keys, "token"])
    pair = met.groupBy(*keys, "e_phrase", "m_phrase").agg(F.count_distinct("token").alias("matches"), (F.max("pos") - F.min("pos") + 1).alias("cover"), F.sum("e_weight").alias("matched"))
    pair = pair.join(totals, [*keys, "e_phrase"])
    weight = phrase_kernel(F.col("matches"), F.col("cover"), F.col("matched"), F.col("total"))
    return pair.groupBy(*keys, "e_phrase").agg(F.max(weight).alias("best"), F.count("*").alias("n_phrases")).groupBy(*keys).agg(F.sum("best").alias("similarity"), F.sum("n_phrases").alias("n_matches"), F.max("best").alias("highest"))
