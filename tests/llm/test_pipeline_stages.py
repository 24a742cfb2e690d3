"""The pipeline: each stage against brute force on what it got, on odd rows, clashing columns and empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import bpe, pii, queries, toxicity
from tessera.llm.scratch import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, value int, n int, bucket string, shard int, score double, seed int, item_id int"


def corpus(spark, folder):
    """Tables of documents with copies, near copies, passages, personal data, toxic words, odd and repeated rows."""
    rng = random.Random(12)
    common = [f"{a}{b}" for a in ("th", "an", "re", "on", "st") for b in ("ing", "er", "al", "ous", "ent", "ick", "ow")]
    bad = ["zvile", "zhate", "zscum", "zrot"]
    text = lambda n: " ".join(rng.choices(common, k=n))
    items = [" ".join(f"q{k}w{j}" for j in range(18)) for k in range(6)]
    rows, toxic = [], {}
    for k in range(160):
        words = text(rng.randrange(20, 60)).split()
        toxic[k] = int(k % 6 == 0)
        if toxic[k]:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(bad, k=8)
        rows.append((k, " ".join(words)))
    rows += [(200 + k, rows[k * 7 + 1][1] + (" extra" if k % 2 else "")) for k in range(12)]
    rows += [(300 + k, f"{text(10)} {items[k]} {text(9)}") for k in range(6)]
    rows += [(400, f"mail me at someone{rng.randrange(99)}@example.org or +49 30 1234567 {text(12)}"), (401, f"card 4111 1111 1111 1111 {text(15)}")]
    rows += [(500, None), (501, ""), (502, "   "), (503, "é ß 漢字 'tis they'll\n\n  end "), (None, text(25)), (504, (text(30) + " ") * 200)]
    rows += rows[30:34]
    more = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, "b", 4, 0.5, 6, 7) for i, t in rows]
    spark.createDataFrame(more, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()] + [(None, 1, 1), (999, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    items = corpus(spark, folder)
    docs = queries.table(spark, folder, "documents")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(cut(stage(spark, seen[-1], folder)))
    return folder, items, seen


def brute_groups(texts, k, threshold=80):
    """The least number of each text's group, by links of sets of k-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def accepted_anywhere(item, own):
    """The rule of decontamination on every diagonal, stretch by stretch."""
    n = len(item)
    for first in range(1 - n, len(own)):
        agree = [0 <= first + k < len(own) and own[first + k] == w for k, w in enumerate(item)]
        if not any(agree):
            continue
        inside = [k for k in range(n) if 0 <= first + k < len(own)]
        if 10 * sum(agree) >= 7 * n or any(5 * sum(agree[a:b]) > 4 * (b - a) for a in range(inside[0], inside[-1] + 1) for b in range(a + min(13, n), inside[-1] + 2)):
            return True
    return False


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxicity(spark, stages):
    folder, _, (docs, kept, *_) = stages
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, queries.table(spark, folder, "labels"), ~toxicity.held_out())
    # Scores go by the text alone, so they can be told text by text.
    scores = {r.text: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "text"), "doc_id").collect()}
    scores |= {r.text: s.score for r, s in zip(docs.where("doc_id is null").collect(), toxicity.score(docs.where("doc_id is null"), model).collect())}
    assert rows_of(kept) == sorted(((r.doc_id, r.text) for r in docs.collect() if scores[r.text] < toxicity.CUTOFF), key=str)
    bad = {r.doc_id for r in docs.collect() if r.text and "z" in r.text}
    assert len(bad & {r.doc_id for r in kept.collect()}) <= len(bad) // 5 and docs.count() - kept.count() <= len(bad) + 2


def test_near_copies(stages):
    _, _, (_, docs, kept, *_) = stages
    assert kept.columns == docs.columns
    distinct = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}, key=str)
    groups = brute_groups([t for _, t in distinct], 5)
    stay = rows_of(kept)
    named = [(i, t) for i, t in stay if i is not None]
    assert len(named) == len(set(named)) == len(set(groups))
    assert {groups[distinct.index(x)] for x in named} == set(groups)
    assert sum(i is None for i, _ in stay) == docs.where("doc_id is null").count()


def test_decontaminated(stages):
    _, items, (_, _, docs, kept, *_) = stages
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = sorted(((r.doc_id, r.text) for r in docs.collect() if not any(accepted_anywhere(words(i), words(r.text)) for i in items)), key=str)
    assert rows_of(kept) == want and kept.columns == docs.columns and len(want) == docs.count() - 6


def test_redacted(stages):
    _, _, (_, _, _, docs, out, _) = stages
    model = pii.selector()
    want = sorted(((r.doc_id, None if r.text is None else pii.cover(r.text, pii.find(r.text, model)[1])) for r in docs.collect()), key=str)
    assert rows_of(out) == want and out.columns == docs.columns
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert any("[EMAIL]" in (t or "") for _, t in want) and any("[CARD]" in (t or "") for _, t in want)


def test_tokens(spark, stages):
    folder, _, (*_, docs, out) = stages
    assert "text" not in out.columns and out.count() == docs.count() == cp.run(spark, folder).count()
    path = queries.vocabulary_path()
    back = bpe.decode(out.withColumn("text", F.lit("")), path)
    assert sorted(((r.doc_id, r.decoded) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_empty_documents(spark, stages):
    folder, _, (docs, *_) = stages
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0, name
    assert all(cut(df).count() == 0 for df in (pii.digests(empty), bpe.digests(empty, queries.vocabulary_path()), queries.license_templates.labels(empty)))
    model = toxicity.fit(empty, queries.table(spark, folder, "labels"), ~toxicity.held_out())
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, model).count() == docs.count()
