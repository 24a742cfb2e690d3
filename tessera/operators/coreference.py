"""Coreference chains inside documents, by ordered sieves.

Each sieve gives a mention at most one antecedent, the surest sieve first:

1. ``exact``: the document's first mention with the same words, whatever their case.
2. ``suffix``: for the first mention of a name, the name that was mentioned last of those that end in
   all its words ("Ann Lee ... Lee").
3. ``pronoun``: the name that was mentioned last of the pronoun's number.

Clusters are joined along antecedents: each name's cluster points to one cluster at most, and to one of
a longer name, so a chain's root is found by pointer doubling in a few joins.  Suffixes are formed only
of lengths that names of the document have, and meet names by equality; no document's mentions are paired.

Edge cases: a null text is no mention; mentions of a null document belong together as those of any other; of mentions
at one place the one with the least text counts; a pronoun without a name before it is a chain of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import TOKEN
from tessera.operators.mentions import capitalised_spans, pattern_spans
from tessera.sources.workspace import drop, stored

# Pronouns by number.
SINGULAR = ["he", "she", "it", "him", "her", "his", "hers", "its", "himself", "herself", "itself"]
PLURAL = ["they", "them", "their", "theirs", "themselves"]

KEYS = ["doc_id", "start"]


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, start, text, pronoun): runs of capitalised words, and pronouns outside them."""
    names = capitalised_spans(docs).select("doc_id", "start", F.col("span").alias("text"), F.lower("span").isin(SINGULAR + PLURAL).alias("pronoun"))
    words = pattern_spans(docs, f"({TOKEN})").where(F.col("span").isin(SINGULAR + PLURAL))
    return names.unionByName(words.select("doc_id", "start", F.col("span").alias("text"), F.lit(True).alias("pronoun")))


def plural(key: Column) -> Column:
    """Whether a name or pronoun stands for several: by the list, "and", or one s at the end."""
    return key.isin(PLURAL) | (~key.isin(SINGULAR) & (F.contains(key, F.lit(" and ")) | key.rlike("[^s]s$")))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def antecedents(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with key and ``before``, the key of the cluster a pronoun joins), and clusters of names (doc_id, key, start, parent)."""
    place = Window.partitionBy("doc_id").orderBy("start")
    rows = found.where("text is not null").groupBy(*KEYS).agg(F.min(F.struct("text", "pronoun")).alias("m")).select(*KEYS, "m.text", "m.pronoun")
    rows = rows.withColumn("key", F.lower("text")).withColumn("several", plural(F.col("key")))
    last = lambda several: F.last(F.when(~F.col("pronoun") & (F.col("several") == several), F.col("key")), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.when(F.col("pronoun"), F.when(F.col("several"), last(True)).otherwise(last(False))))
    rows = stored(rows.select(*KEYS, "text", "pronoun", "key", "before"))

    names = rows.where("not pronoun").select(*KEYS, "key", F.split("key", " ").alias("words"))
    first = names.groupBy("doc_id", "key").agg(F.min("start").alias("start"), F.size(F.first("words")).alias("n"))
    lengths = first.groupBy("doc_id").agg(F.collect_set("n").alias("lengths"))
    longer = names.where(F.size("words") > 1).alias("x").join(lengths.alias("l"), F.col("x.doc_id").eqNullSafe(F.col("l.doc_id"))).select("x.doc_id", "x.start", "x.key", "x.words", F.explode(F.filter("l.lengths", lambda n: n < F.size("x.words"))).alias("n"))
    ends = longer.select("doc_id", "start", F.array_join(F.slice("words", -F.col("n"), F.col("n")), " ").alias("key"), F.col("key").alias("whole"))
    both = ends.unionByName(first.select("doc_id", "start", "key", F.lit(None).cast("string").alias("whole")))
    earlier = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parents = both.withColumn("parent", F.last("whole", ignorenulls=True).over(earlier)).where("whole is null").select("doc_id", "key", "start", "parent")
    return rows, parents


def cluster_roots(parents: DataFrame) -> DataFrame:
    """(doc_id, key, root): the first place of the cluster at the end of each cluster's chain.

    A parent has more words, so rounds are at most the logarithm of the words of the longest name.
    """
    now = stored(parents.select("doc_id", "key", F.coalesce("parent", "key").alias("top")))
    while True:
        moved = Observation()
        ahead = now.where("key <> top").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("top").alias("_t"))
        step = now.join(ahead, same("doc_id", "_d") & (F.col("top") == F.col("_k")), "left").select("doc_id", "key", F.coalesce("_t", "top").alias("top"), F.col("_t").isNotNull().alias("moved"))
        after = stored(step.observe(moved, F.count(F.when(F.col("moved") & (F.col("key") != F.col("top")), 1)).alias("n")).drop("moved"))
        drop(now)
        now = after
        if not moved.get["n"]:
            break
    places = parents.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("start").alias("root"))
    return now.join(places, same("doc_id", "_d") & (F.col("top") == F.col("_k"))).select("doc_id", "key", "root")


def chains(found: DataFrame) -> DataFrame:
    """doc_id, start, text, sieve, chain: ``chain`` is the place of the first mention of the root cluster.

    ``found``: doc_id, start, text, pronoun.
    """
    rows, parents = antecedents(found)
    parents = stored(parents)
    roots = stored(cluster_roots(parents).join(parents.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("start").alias("first"), "parent"), same("doc_id", "_d") & (F.col("key") == F.col("_k"))).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "root", "first", "parent"))
    joined = rows.withColumn("of", F.when(F.col("pronoun"), F.col("before")).otherwise(F.col("key"))).join(roots, same("doc_id", "_d") & (F.col("of") == F.col("_k")), "left")
    sieve = F.when(F.col("pronoun"), F.when(F.col("before").isNotNull(), "pronoun").otherwise("none")).when(F.col("start") > F.col("first"), "exact").when(F.col("parent").isNotNull(), "suffix").otherwise("none")
    return joined.select("doc_id", "start", "text", sieve.alias("sieve"), F.coalesce("root", "start").alias("chain"))
