"""Candidate generation: dictionaries, redirects, fallbacks, recall status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators.ranking import top_k


def left_join(dictionary: DataFrame, ids: DataFrame, left: str, right: str) -> DataFrame:
    return dictionary.join(ids, dictionary[left] == ids[right], "left")


def resolve_redirects(df: DataFrame, redirects: DataFrame, entity: str = "entity") -> DataFrame:
    """One hop: the target where there is one (``redirects``: entity, target)."""
    one = redirects.select(F.col("entity").alias("_from"), "target")
    return df.join(one, F.col(entity) == F.col("_from"), "left").withColumn(entity, F.coalesce("target", entity)).drop("_from", "target")


def cascade(mentions: DataFrame, dictionary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Candidates by the first key that has any: fixed form (or the raw one if it has more), lower case, fallback.

    ``mentions``: query_id, mention.  ``dictionary`` and ``fallback``: mention, entity, prior.
    """
    m = F.col("mention")
    keys = mentions.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("way"), tx.fix_upper_case(m).alias("form")), F.struct(F.lit(1).alias("way"), m.alias("form")), F.struct(F.lit(2).alias("way"), F.lower(m).alias("form")), F.struct(F.lit(3).alias("way"), tx.normalize_form(m).alias("form")))).alias("k")).select("query_id", "k.way", "k.form")
    first = keys.where("way < 3").join(dictionary.withColumnRenamed("mention", "form"), "form")
    last = keys.where("way = 3").join(fallback.withColumnRenamed("mention", "form"), "form")
    found = first.union(last.select(*first.columns))
    sizes = found.groupBy("query_id", "way").count()
    # The raw form wins over the fixed one only with more candidates; below them ways follow in turn.
    rank = F.when(F.col("way") < 2, 0).otherwise(F.col("way"))
    best = sizes.groupBy("query_id").agg(F.min(F.struct(rank.alias("r"), (-F.col("count")).alias("n"), "way")).alias("b")).select("query_id", F.col("b.way").alias("way"))
    return found.join(best, ["query_id", "way"]).select("query_id", "entity", "prior", "way")


def top_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The n best by prior, ties by place; n = 0 means all."""
    order = [F.desc("prior"), F.asc("pos")]
    return top_k(candidates, ["query_id"], order, n) if n else candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def recall_status(queries: DataFrame, candidates: DataFrame, articles: DataFrame) -> DataFrame:
    """none, no_gold, no_article or valid for each query (``queries``: query_id, gold)."""
    sizes = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    gold = queries.join(candidates.select("query_id", F.col("entity").alias("gold")).distinct().withColumn("has", F.lit(True)), ["query_id", "gold"], "left")
    full = gold.join(sizes, "query_id", "left").join(articles.select(F.col("entity").alias("gold")).distinct().withColumn("article", F.lit(True)), "gold", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "none").when(F.col("has").isNull(), "no_gold").when(F.col("article").isNull(), "no_article").otherwise("valid")
    return full.select("query_id", status.alias("status"))


def without_first(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with the first occurrence of the gold entity taken out; later ones stay."""
    rows = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "entity").orderBy("pos")))
    return rows.join(gold.withColumnRenamed("entity", "gold"), "query_id").where((F.col("entity") != F.col("gold")) | (F.col("nth") > 1)).drop("nth", "gold")


def whitelisted(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates in their mention's filter; a mention without a filter drops out."""
    return candidates.join(allowed.select("query_id", "entity").distinct(), ["query_id", "entity"], "left_semi")


def missed_only(candidates: DataFrame, missed: DataFrame) -> DataFrame:
    """Candidates of mentions whose gold entity was missed before; the first one stands in as gold."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return candidates.join(missed.select("query_id"), "query_id", "left_semi").withColumn("label", (first == 1).cast("int"))


def first_prior(candidates: DataFrame) -> DataFrame:
    """The prior of each query's first candidate in the dictionary's order."""
    return candidates.groupBy("query_id").agg(F.max_by("prior", F.struct(F.col("prior"), -F.col("pos"))).alias("first_prior"))


def any_of(df: DataFrame, columns: list[str], values: DataFrame) -> DataFrame:
    """Rows of which one column or another stands in a list (``values``: value), once each."""
    found = F.lit(False)
    for i, c in enumerate(columns):
        df = df.join(values.select(F.col("value").alias(c), F.lit(True).alias(f"_in{i}")).distinct(), c, "left")
        found = found | F.col(f"_in{i}").isNotNull()
    return df.where(found).drop(*(f"_in{i}" for i in range(len(columns))))


def in_array(df: DataFrame, lists: DataFrame, key: str, array: str) -> DataFrame:
    """Rows whose key stands in any of the arrays."""
    return df.join(lists.select(F.explode(array).alias(key)).distinct(), key, "left_semi")


def in_category(df: DataFrame, column: str, category: str) -> DataFrame:
    """Rows whose category text names a category."""
    return df.where(F.contains(F.lower(column), F.lit(category.lower())))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``, an order by hash that the seed fixes; ties by key."""
    mixed = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return df.withColumn("place", mixed)


def others(df: DataFrame, key: str, value: str, own: str) -> DataFrame:
    """The distinct values of a key's rows without the own one."""
    return df.where(~F.col(value).eqNullSafe(F.col(own))).select(key, own, value).distinct()


def last_prior(candidates: DataFrame) -> DataFrame:
    """Of repeated candidates the prior of the last one counts."""
    return candidates.groupBy("query_id", "entity").agg(F.max_by("prior", "pos").alias("prior"))
