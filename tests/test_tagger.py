"""The sequence tagger: decoding against brute force, mixing against one plain pass, and quality on rows held back."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import mentions as mn
from tessera.operators import tagger as tg


def test_decoding_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        scores, steps = rng.integers(-4, 5, (n, 3)).astype(float), rng.integers(-3, 4, (4, 3)).astype(float)

        def total(tags):
            before = (3, *tags[:-1])
            if any(t == tg.INSIDE and b in (tg.OUTSIDE, 3) for b, t in zip(before, tags)):
                return -np.inf
            return sum(scores[i, t] for i, t in enumerate(tags)) + sum(steps[b, t] for b, t in zip(before, tags))

        best = max(total(t) for t in itertools.product(range(3), repeat=n))
        assert total(tuple(tg.viterbi(scores, steps).tolist())) == best


def test_sentences_and_truth():
    text = "Ann Lee met Bob. He left\nNew York City 3"
    assert [[text[a:b] for a, b in s] for s in tg.sentences(text)] == [["Ann", "Lee", "met", "Bob"], ["He", "left"], ["New", "York", "City", "3"]]
    tokens = [t for s in tg.sentences(text) for t in s]
    spans = [(0, 7), (12, 15), (25, 33), (34, 38), (90, 95)]
    assert tg.truth(tokens, spans).tolist() == [1, 2, 0, 1, 0, 0, 1, 2, 1, 0]
    assert [len(s) for s in tg.sentences("w " * 200)] == [80, 80, 40] and list(tg.sentences("  ..")) == []


def made(spark, n=300):
    rng = random.Random(2)
    names, places, verbs = ["Ann", "Bob", "Lee"], ["Rome", "Oslo"], ["saw", "met", "left"]
    rows, spans = [], []
    for d in range(n):
        text = ""
        for _ in range(rng.randrange(4)):
            who, where = f"{rng.choice(names)} {rng.choice(['lee', 'Smith', 'de'])}", rng.choice(places)
            spans.append((d, len(text), who))
            text += f"{who} {rng.choice(verbs)} the man in "
            spans.append((d, len(text), where))
            text += f"{where}. "
        rows.append((d, text))
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame(spans, "doc_id long, start int, span string")


def test_learns_spans_and_is_the_same_on_any_cut(spark):
    docs, spans = made(spark)
    seen = F.col("doc_id") % 3 > 0
    first = tg.train(docs.where(seen).repartition(5), spans, passes=3, part_docs=50)
    again = tg.train(docs.where(seen).coalesce(1), spans.repartition(3), passes=3, part_docs=50)
    assert (first.weights == again.weights).all() and (first.steps == again.steps).all()
    q = tg.quality(tg.recognise(docs.where(~seen), first), spans.where(~seen)).first()
    assert q.n_spans > 100 and q.p > 0.97 and q.r > 0.97


def test_one_part_is_a_plain_perceptron(spark):
    docs, spans = made(spark, 20)
    marks = {}
    for r in spans.collect():
        marks.setdefault(r.doc_id, []).append((r.start, r.start + len(r.span)))
    keyed = docs.where("text is not null").select(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary")).alias("k"), "doc_id", "text").orderBy("k").collect()
    rows = [(r.text, sorted(marks.get(r.doc_id, []))) for r in keyed]
    delta, mean, _ = tg.learnt(iter(rows), tg.blank())
    model = tg.train(docs, spans, passes=1, part_docs=1000)
    assert np.allclose(np.concatenate([model.weights, model.steps]), mean / tg.UNIT) and delta.any()


def test_nothing_to_learn_or_read(spark):
    docs, spans = made(spark, 5)
    model = tg.train(docs.limit(0), spans.limit(0), passes=1)
    assert tg.recognise(docs, model).count() == 0 and tg.recognise(docs.limit(0), model).count() == 0
    q = tg.quality(tg.recognise(docs, model), spans.limit(0)).first()
    assert (q.n_found, q.n_spans, q.p, q.r) == (0, 0, 0.0, 0.0)


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "Ann Lee saw the man in Rome. " * 3000)], "doc_id long, text string")
    spans = mn.capitalised_spans(docs)
    model = tg.train(docs, spans, passes=1)
    q = tg.quality(tg.recognise(docs, model), spans).first()
    assert q.n_spans == 6000 and q.r > 0.99


def test_texts_read_together_are_as_texts_read_alone(spark, monkeypatch):
    """Many texts a batch, cut anywhere: spans, tags and lessons are each text's own, whatever spans are given."""
    rng = random.Random(4)
    words = ["Ann", "lee", "New York", "x_1", "Été", "3", "B."]
    texts = ["", " .. ", *("".join(rng.choice(words) + rng.choice([" ", "  ", ". ", "\n", "?"]) for _ in range(rng.randrange(1, 200))) for _ in range(40)), "w " * 200]
    rows = [(t, sorted((rng.randrange(-3, len(t) + 3), rng.randrange(len(t) + 9)) for _ in range(rng.randrange(6)))) for t in texts]
    delta, mean, seen = tg.learnt(iter(rows), tg.blank())
    chance = np.random.default_rng(3)
    model = tg.Model(chance.integers(-9, 10, (tg.SLOTS, 3)) / 7, chance.integers(-9, 10, (4, 3)) / 7)
    alone = [tg.spans_of(t, model) for t in texts]
    for size in (1, 50, 1 << 17):
        monkeypatch.setattr(tg, "CHUNK", size)
        again = tg.learnt(iter(rows), tg.blank())
        assert (again[0] == delta).all() and (again[1] == mean).all() and again[2] == seen
        out = [[] for _ in texts]
        for (_, i), a, b in tg.spans_of_rows(((t, i) for i, t in enumerate(texts)), model):
            out[i].append((a, b))
        assert out == alone and sum(map(len, out)) > 100


def test_a_file_of_one_group_is_read_by_many_tasks(spark):
    docs, spans = made(spark, 60)
    found = tg.recognise(docs.coalesce(1), tg.train(docs, spans, passes=1))
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
