"""Lemmas by edit scripts learnt from a corpus's own words.

A script takes up to STRIP letters off a word's end and adds one of ADDED.  It holds for a word if it
gives a word of the corpus at least as frequent.  Words are classed by their last CLASS letters; of a
class's scripts the one that holds for the most words counts, if it holds for a fair share of them.
Words meet their candidates by equality, at most STRIP * len(ADDED) rows a word; no pairs are formed.

Edge cases: words shorter than LEAST letters, with other characters than letters, and words of a class
without a script stay as they are; so do nulls; on ties the shorter strip counts, then the lesser addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters that a class looks at, that a script may take off, that a word has and that a lemma keeps, at least.
CLASS, STRIP, LEAST, KEPT = 3, 3, 5, 3
# What a script may add.
ADDED = ["", "e", "y"]
#: Rows of rules that a broadcast holds at most; more are joined in a shuffle.
BROADCAST_RULES = 1 << 16


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(word, n): the words of letters and how often they stand."""
    return tokens.where(F.col(token).rlike(r"^\p{L}+$")).groupBy(F.col(token).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def candidates(words: DataFrame) -> DataFrame:
    """(word, n, class, strip, added, lemma): what every script would make of each long enough word."""
    scripts = [(k, a) for k in range(1, STRIP + 1) for a in ADDED]
    rows = words.where(F.length("word") >= LEAST).select("word", "n", F.substring("word", -CLASS, CLASS).alias("class"), F.explode(F.array(*(F.struct(F.lit(k).alias("strip"), F.lit(a).alias("added")) for k, a in scripts))).alias("s"))
    lemma = F.concat(F.expr("substring(word, 1, length(word) - s.strip)"), F.col("s.added"))
    return rows.select("word", "n", "class", "s.strip", "s.added", lemma.alias("lemma")).where((F.length("word") - F.col("strip") >= KEPT) & (F.col("lemma") != F.col("word")))


def induce(words: DataFrame, support: int = 3, share: float = 0.25) -> DataFrame:
    """(class, strip, added, support, words): the script of each class that has one."""
    known = words.select(F.col("word").alias("lemma"), F.col("n").alias("n_lemma"))
    holds = candidates(words).join(known, "lemma").where("n_lemma >= n").groupBy("class", "strip", "added").agg(F.count(F.lit(1)).alias("support"))
    sizes = words.where(F.length("word") >= LEAST).groupBy(F.substring("word", -CLASS, CLASS).alias("class")).agg(F.count(F.lit(1)).alias("words"))
    first = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("support"), "strip", "added"))
    best = holds.withColumn("first", first).where("first = 1").join(sizes, "class")
    return best.where((F.col("support") >= support) & (F.col("support") >= F.lit(share) * F.col("words"))).select("class", "strip", "added", "support", "words")


def lemmatised(tokens: DataFrame, rules: DataFrame, token: str = "token") -> DataFrame:
    """``tokens`` with ``lemma``; ``rules`` is counted first and broadcast while it is small."""
    table = rules.select(F.col("class").alias("_class"), F.col("strip").alias("_strip"), F.col("added").alias("_added"))
    table = F.broadcast(table) if rules.count() <= BROADCAST_RULES else table
    fits = F.when((F.length(token) >= LEAST) & F.col(token).rlike(r"^\p{L}+$"), F.substring(token, -CLASS, CLASS))
    out = tokens.join(table, fits == F.col("_class"), "left")
    made = F.concat(F.expr(f"substring(`{token}`, 1, length(`{token}`) - _strip)"), F.col("_added"))
    return out.withColumn("lemma", F.when(F.col("_class").isNotNull() & (F.length(token) - F.col("_strip") >= KEPT), made).otherwise(F.col(token))).drop("_class", "_strip", "_added")
