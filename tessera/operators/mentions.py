"""Mentions in documents: nearest related mention, best priors, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def doc_entity_max_prior(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Highest prior of an entity over its document's distinct mentions."""
    pairs = mentions.select("doc_id", "mention").distinct()
    return pairs.join(candidates, "mention").groupBy("doc_id", "entity").agg(F.max("prior").alias("max_prior"))


def nearest_related(mentions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The surface form that a mention most likely stands for, or the mention itself.

    ``mentions``: query_id, doc_id, mention, offset; ``surfaces``: doc_id, surface, at, seq.  Forms
    must be longer than the mention and begin or end with it, whatever the case.  Distance 0 wins,
    then the nearest before, then the nearest after, then the form seen first.

    Documents may hold many mentions of few forms: each (form, place) and each (mention, place) of a
    document is looked at once, and a mention meets the last form up to its place, never all of them.
    """
    keys = ["doc_id", "piece", "size"]
    asked = mentions.select("query_id", "doc_id", F.lower("mention").alias("piece"), F.length("mention").alias("size"), "offset")
    low, places = F.lower("surface"), F.sequence(F.lit(0), F.length(F.lower("surface")))
    # Forms meet mentions by their beginnings and ends.
    ends = F.concat(F.transform(places, lambda n: F.left(low, n)), F.transform(places, lambda n: F.right(low, n)))
    pieces = surfaces.select("doc_id", "surface").distinct().withColumn("piece", F.explode(F.array_distinct(ends)))
    fits = pieces.join(asked.select(*keys).distinct(), ["doc_id", "piece"]).where(F.length("surface") > F.col("size"))
    first = surfaces.groupBy("doc_id", "surface", "at").agg(F.min("seq").alias("seq"))
    forms = fits.join(first, ["doc_id", "surface"]).groupBy(*keys, "at").agg(F.min(F.struct("seq", "surface")).alias("f"))
    form = F.struct("at", "f.seq", "f.surface")
    spots = asked.select(*keys, "offset").distinct()
    line = forms.select(*keys, "at", F.lit(0).alias("is_asked"), form.alias("form")).unionByName(spots.select(*keys, F.col("offset").alias("at"), F.lit(1).alias("is_asked"), F.lit(None).cast(forms.select(form.alias("x")).schema["x"].dataType).alias("form")))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("at", "is_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("at").isNotNull(), F.col("form")), ignorenulls=True).over(upto)
    # Where no form stands before, the first of all is the nearest after; forms without a place come last.
    after = F.min(F.when(F.col("form").isNotNull(), F.struct(F.col("at").isNull().alias("none"), F.col("at").alias("x"), F.col("form").alias("form")))).over(group)["form"]
    eldest = F.min(F.when(F.col("form").isNotNull(), F.struct(F.col("form.seq").alias("x"), F.col("form").alias("form")))).over(group)["form"]
    met = line.withColumn("found", F.when(F.col("at").isNull(), eldest).otherwise(F.coalesce(near, after))).where("is_asked = 1 and found is not null")
    met = met.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("at").alias("_offset"), "found")
    same_spot = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("offset").eqNullSafe(F.col("_offset"))]
    d = F.col("offset") - F.col("found.at")
    order = F.struct(F.coalesce((d != 0).cast("int"), F.lit(2)).alias("a"), (d < 0).cast("int").alias("b"), F.abs(d).alias("c"), F.col("found.seq").alias("d"), F.col("found.surface").alias("e"))
    best = asked.join(met, same_spot).groupBy("query_id").agg(F.min_by("found.surface", order).alias("surface"))
    return mentions.join(best, "query_id", "left").select("query_id", F.coalesce("surface", "mention").alias("surface"))


def representative(tokens: DataFrame, chains: DataFrame) -> DataFrame:
    """A chain's representative text for each word, (-1, word) where no chain starts there.

    ``tokens``: doc_id, sentence, start, word; ``chains``: doc_id, sentence, start, chain, text, is_representative.
    """
    first = chains.groupBy("doc_id", "sentence", "start").agg(F.min("chain").alias("chain"))
    rep = chains.where("is_representative").groupBy("doc_id", "chain").agg(F.min("text").alias("text"))
    found = tokens.join(first, ["doc_id", "sentence", "start"], "left").join(rep, ["doc_id", "chain"], "left")
    return found.select("doc_id", "sentence", "start", "word", F.coalesce("chain", F.lit(-1)).alias("chain"), F.coalesce("text", "word").alias("text"))


def same_spans(coref: DataFrame, ner: DataFrame) -> DataFrame:
    return coref.join(ner, ["doc_id", "sentence", "start", "end"])


# Fixed value: words that begin with a capital, in a row.
SPAN = r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"


def without_types(spans: DataFrame, column: str = "ner") -> DataFrame:
    # Entity types that are no mentions.
    excluded = ["DATE", "TIME", "PERCENT", "MONEY", "QUANTITY", "ORDINAL", "CARDINAL", "NUMBER", "DURATION"]
    return spans.where(~F.col(column).isin(excluded))


def pattern_spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, span, start): every match of ``pattern``, one group around the whole of it, and the place of its first character.

    Text between matches and the matches themselves come from one pattern, so places are sums of lengths.
    """
    runs = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    between = F.transform(F.split("text", pattern, -1), F.length)
    rows = docs.select("doc_id", runs.alias("runs"), between.alias("gaps")).where(F.size("runs") > 0)
    steps = F.transform(F.arrays_zip("runs", F.slice("gaps", F.lit(1), F.size("runs")).alias("gaps")), lambda x: F.struct(x["runs"].alias("span"), x["gaps"].alias("gap")))
    rows = rows.select("doc_id", F.posexplode(steps).alias("nth", "s"))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("s.gap") + F.length("s.span")).over(before), F.lit(0))
    return rows.select("doc_id", F.col("s.span").alias("span"), (passed + F.col("s.gap")).cast("int").alias("start"))


def capitalised_spans(docs: DataFrame) -> DataFrame:
    """Every run of capitalised words and the place of its first character: a stand-in for a recogniser."""
    return pattern_spans(docs, SPAN)


def max_surface_offsets(mentions: DataFrame) -> DataFrame:
    """Each document's surface forms with their offsets in order."""
    return mentions.groupBy("doc_id", "surface").agg(F.sort_array(F.collect_list("at")).alias("offsets"))


def document_mentions(mentions: DataFrame) -> DataFrame:
    """Each document's mentions in order of their offsets."""
    return mentions.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "surface"))), lambda x: x["surface"]).alias("mentions"))


def entity_sets(candidates: DataFrame) -> DataFrame:
    """Each mention's distinct entities, in order."""
    return candidates.groupBy("mention").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
