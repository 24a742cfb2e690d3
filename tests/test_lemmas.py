"""Edit scripts against plain Python, and odd rows."""

import collections
import random
import re

from pyspark.sql import functions as F

from tessera.operators import lemmas as lm


def plain(tokens, support, share):
    n = collections.Counter(t for t in tokens if t and re.fullmatch(r"[^\W\d_]+", t))
    held, size = collections.defaultdict(collections.Counter), collections.Counter()
    for w in (w for w in n if len(w) >= 5):
        size[w[-3:]] += 1
        for k in (1, 2, 3):
            for a in lm.ADDED:
                v = w[: len(w) - k] + a
                if len(w) - k >= 3 and v != w and n.get(v, 0) >= n[w]:
                    held[w[-3:]][k, a] += 1
    out = {}
    for c, scripts in held.items():
        (k, a), s = min(scripts.items(), key=lambda x: (-x[1], x[0]))
        if s >= support and s >= share * size[c]:
            out[c] = (k, a, s, size[c])
    return out


def test_rules_and_lemmas(spark):
    rng = random.Random(7)
    stems = ["walk", "talk", "jump", "cart", "bake", "make", "carr", "hurr", "été", "größ"]
    tokens = [s + rng.choice(["", "", "", "s", "ed", "ing", "e", "y", "ied", "ies"]) for s in stems for _ in range(60)] + [None, "", "s", "ab1", "x_y", "1999s"] + ["ring"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k int, token string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    for support, share in ((3, 0.25), (1, 0.0), (2, 0.6)):
        rules = lm.induce(lm.vocabulary(df.select("token")), support, share)
        want = plain(tokens, support, share)
        assert {r["class"]: (r.strip, r.added, r.support, r.words) for r in rules.collect()} == want and want
        got = {r.k: r.lemma for r in lm.lemmatised(df, rules).collect()}
        for k, t in enumerate(tokens):
            rule = want.get(t[-3:]) if t and len(t) >= 5 and re.fullmatch(r"[^\W\d_]+", t) else None
            assert got[k] == (t[: len(t) - rule[0]] + rule[1] if rule and len(t) - rule[0] >= 3 else t)
    assert any(got[k] != t for k, t in enumerate(tokens))


def test_large_rule_tables_and_empty_ones(spark, monkeypatch):
    df = spark.createDataFrame([("walks",), ("walk",), ("walk",)], "token string")
    rules = lm.induce(lm.vocabulary(df), 1, 0.0)
    want = sorted(r.lemma for r in lm.lemmatised(df, rules).collect())
    monkeypatch.setattr(lm, "BROADCAST_RULES", 0)
    assert sorted(r.lemma for r in lm.lemmatised(df, rules).collect()) == want == ["walk", "walk", "walk"]
    assert lm.induce(lm.vocabulary(df.limit(0))).count() == 0 and lm.lemmatised(df.limit(0), rules).count() == 0
