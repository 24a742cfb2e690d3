"""Source divergence against plain Python, its SQL twin, and odd rows."""

import collections
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence as dv

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    rows = [((lang or ""), (source or ""), re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) for lang, source, text in rows]
    found = []
    for lang in {r[0] for r in rows}:
        docs, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for _, source, text in (r for r in rows if r[0] == lang):
            words = TERMS.findall(text)
            docs.update(set(words))
            counts[source].update(words)
        kept = [t for t, n in docs.items() if n >= least]
        share = lambda c, n_all: {t: 1 + 10**9 * (c[t] + 5) // (n_all + 5 * len(kept)) for t in kept}
        p = {s: share(c, sum(c[t] for t in kept)) for s, c in counts.items()}
        every = sum(counts.values(), collections.Counter())
        q = share(every, sum(every[t] for t in kept))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                found += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(found)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def made(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "ab", "straße", "É", "é", "漢字", "b2c", "x_y", "ÀB", "İi", "c", "dd", "eee", "\U0001f600"]
    pick = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 12)))
    rows = [(rng.choice(["en", "de", None, ""]), "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "S1", None, "é"]), rng.choice([pick(), None, ""]) if rng.random() < 0.2 else pick()) for _ in range(n)]
    return [*rows, *rows[:20], ("fr", "only", "never often enough"), ("it", "a", "1 2 3"), ("it", "b", None), ("nl", "a", "zz " * 3), ("nl", "b", "zz")]


@pytest.mark.parametrize(("least", "top", "flush", "merge"), [(3, 50, 1 << 24, 1 << 20), (1, 2, 64, 5), (2, 3, 1, 1)])
def test_against_brute_force(spark, monkeypatch, least, top, flush, merge):
    monkeypatch.setattr(dv, "FLUSH_BYTES", flush)
    monkeypatch.setattr(dv, "MERGE_ROWS", merge)
    rows = made(least, 150)
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "item", "value", "rank", "doc_id")})
    assert rows_of(dv.divergence(df.repartition(3), least, top)) == brute(rows, least, top)


def test_whole_documents_against_sql(spark, documents):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(f"select lang, source, part, item, value, rank from ({dv.DIVERGENCE_SQL})").fetchall())
    assert rows_of(dv.divergence(documents)) == want and want


def test_empty_and_odd(spark, documents, odd):
    assert dv.divergence(documents.limit(0)).count() == 0
    got = dv.divergence(odd, least=1)
    assert rows_of(got) == brute([(r.lang, r.source, r.text) for r in odd.collect()], 1, 50)
    assert [f.simpleString() for f in got.schema] == ["lang:string", "source:string", "part:string", "item:string", "value:bigint", "rank:int"]
