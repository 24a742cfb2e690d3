"""Coreference chains by hand, at random against plain Python, and on odd rows."""

import random

from pyspark.sql import functions as F

from tessera.operators import coreference as cr


def plain(rows):
    """(doc, start) -> (sieve, chain), sieve by sieve."""
    out = {}
    for doc in {r[0] for r in rows}:
        own = sorted({r[1]: min(x for x in rows if x[0] == doc and x[1] == r[1] and x[2] is not None) for r in rows if r[0] == doc and r[2] is not None}.values())
        root, first = {}, {}
        several = lambda k: k in cr.PLURAL or (k not in cr.SINGULAR and (" and " in k or (k.endswith("s") and len(k) > 1 and k[-2] != "s")))
        for _, start, text, pronoun in own:
            key = text.lower()
            names = [(s, t.lower()) for _, s, t, p in own if s < start and not p]
            if pronoun:
                fit = [k for _, k in names if several(k) == several(key)]
                out[doc, start] = ("pronoun", root[fit[-1]]) if fit else ("none", start)
            elif key in first:
                out[doc, start] = ("exact", root[key])
            else:
                longer = [k for _, k in names if k.endswith(" " + key)]
                first[key], root[key] = start, root[longer[-1]] if longer else start
                out[doc, start] = ("suffix" if longer else "none", root[key])
    return out


def rows_of(df):
    return {(r.doc_id, r.start): (r.sieve, r.chain) for r in df.collect()}


SCHEMA = "doc_id long, start int, text string, pronoun boolean"


def test_chains_by_hand(spark):
    text = "Ann Lee met the Smiths. She saw them. Lee and ANN LEE left; Lee smiled at Bob Ann Lee. Ann Lee. it"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "they left, he stayed")], "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("start", F.lit(0))
    got = sorted((r.doc_id, r.start, r.text, r.sieve, r.chain) for r in cr.chains(cr.mentions(df)).collect())
    assert got == [
        (1, 0, "Ann Lee", "none", 0), (1, 16, "Smiths", "none", 16), (1, 24, "She", "pronoun", 0), (1, 32, "them", "pronoun", 16), (1, 38, "Lee", "suffix", 0),
        (1, 46, "ANN LEE", "exact", 0), (1, 60, "Lee", "exact", 0), (1, 74, "Bob Ann Lee", "none", 74), (1, 87, "Ann Lee", "exact", 0), (1, 96, "it", "pronoun", 0),
        (4, 0, "they", "none", 0), (4, 11, "he", "none", 11),
    ]


def test_at_random(spark):
    rng = random.Random(8)
    names = ["Ann", "Lee", "Ann Lee", "Bob Ann Lee", "Lees", "Dan Bob Ann Lee", "Bob And Lee", "LEE", "Bass", "X Lees"]
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(400), *rng.choice([(rng.choice(names), False), (rng.choice(["he", "they", "It"]).lower(), True)])) for _ in range(300)] + [(9, 1, None, False)]
    rows += rows[:20]
    assert rows_of(cr.chains(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert cr.chains(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_of_names(spark):
    long = " ".join(f"N{k}" for k in range(3000))
    df = spark.createDataFrame([(1, 0, long, False), (1, 20000, "N2998 N2999", False), (1, 20100, "N2999", False), (1, 20200, "N0", False)], SCHEMA)
    assert rows_of(cr.chains(df)) == {(1, 0): ("none", 0), (1, 20000): ("suffix", 0), (1, 20100): ("suffix", 0), (1, 20200): ("none", 20200)}
