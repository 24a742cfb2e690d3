"""Spelling variants against plain Python, and odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling as sp

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in RUNS.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % sp.LOSS == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    around = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: min(a, key=lambda o: (-words[o], o)) for w, a in around.items() if a}
    form = {w: f for w, f in form.items() if words[f] >= 5 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(around[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r["form"], r["root"], r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def made(seed):
    rng, letters = random.Random(seed), "abé"
    words = ["".join(rng.choices(letters, k=rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababa", "Bababab", "×÷×÷×÷", "ÀÀÀààà", "a" * 300, "a" * 299 + "b", "a" * 298]
    heavy = [w for w in words for _ in range(rng.choice([1, 4, 5, 6, 30, 160]))]
    heavy += ["qwerty"] * 8 + ["qwerta"] * 60 + ["qwertza"] * 450
    rng.shuffle(heavy)
    docs = [(k // 2 if k % 7 else None, rng.choice(" ,_1\n").join(heavy[k::60])) for k in range(60)]
    return [*docs, docs[0], (77, None), (78, ""), (79, "short words only")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sp, "LOSS", 7)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as id", "3 as key", "'r' as run", "4 as at")
    got = rows_of(sp.variants(df.repartition(3)))
    assert got == brute(rows) and any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])


def test_documents_against_brute_force(spark, documents):
    assert rows_of(sp.variants(documents)) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_collisions_are_settled_on_strings(spark, monkeypatch):
    true = sp.deletion_keys

    def coarse(texts):
        keys, places, owners = true(texts)
        return keys & 7, places, owners

    rows = made(5)
    monkeypatch.setattr(sp, "deletion_keys", coarse)
    ids = {w: k for k, w in enumerate(r[0] for r in brute(rows))}
    made_keys = list(sp.key_batches([pa.RecordBatch.from_arrays([pa.array(ids.values(), pa.int64()), pa.array(ids, pa.string())], ["id", "word"])]))
    assert len(set(pa.Table.from_batches(made_keys)["key"].to_pylist())) <= 8
    from tessera.llm.scratch import cut

    counts = {r[0]: r[3] for r in brute(rows)}
    dictionary = cut(spark.createDataFrame([(k, w, counts[w]) for w, k in ids.items()], "id long, word string, n long"))
    monkeypatch.setattr(sp, "key_batches", lambda batches: iter(()))  # the workers have their own copy of the module, so keys come from here
    keys = cut(spark.createDataFrame(pa.Table.from_batches(made_keys).to_pandas()).selectExpr("key", "cast(at as int) as at", "id"))
    monkeypatch.setattr(sp, "bounded_batches", lambda df: type("K", (), {"mapInArrow": staticmethod(lambda f, s: keys)}))
    got = {r.id: (r.n_near, r["form"]) for r in sp.near_words(dictionary).collect()}
    want = {ids[w]: sum(near(w, o) for o in ids) for w in ids}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, n in want.items() if n}


def test_keys_equal_those_of_the_strings_left(spark):
    words = ["abcdef", "abdef", "abcxef", "x" * 50, "éabcdef"]
    keys, places, owners = sp.deletion_keys(words)
    rest = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for p, o in zip(places, owners)]
    whole = {w: int(k) for w, k in zip(sorted(set(rest)), sp.deletion_keys(sorted(set(rest)))[0])}
    assert [whole[r] for r in rest] == keys.tolist() and len(set(whole.values())) == len(whole)


def test_shared_keys_over_batches():
    keys, ids = np.array([1, 1, 2, 3, 3, 3, 4, 5, 5]), np.array([7, 7, 8, 1, 2, 1, 9, 3, 4])
    for size in (1, 2, 4, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(np.zeros(len(keys[k : k + size]), np.int32)), pa.array(ids[k : k + size])], ["key", "at", "id"]) for k in range(0, 9, size)]
        got = pa.Table.from_batches(list(sp.shared_batches(batches)))
        assert got["key"].to_pylist() == [3, 3, 3, 5, 5]


def test_empty_and_odd(spark, documents, odd):
    assert sp.variants(documents.limit(0)).count() == 0
    got = sp.variants(odd)
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert [f.simpleString() for f in got.schema] == ["word:string", "form:string", "root:string", "n:bigint", "n_near:bigint", "form_n:bigint"]
