"""Operators and their queries on small tables, against brute force, and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, components, decontam, fixity, license_templates, minhash_join, pii, queries, sharding, suffix_dedup, topk, toxicity

SF = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_sharding(spark, documents, odd):
    got = sharding.assign(documents).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(got) == len(texts)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sums) <= set(range(8)) and max(sums.values()) < 1.1 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(odd).count() == odd.count()
    assert sharding.assign(odd.limit(0)).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    per = sharding.assign(hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in per) < 1.02 * min(r.b for r in per)


def test_sharding_keeps_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LANE_GROUPS", 64)
    df = spark.createDataFrame([(i, f"text {i % 400} " + "x" * (i % 400 % 37)) for i in range(3000)] + [(9000 + i, "y" * 500) for i in range(8)], "doc_id long, text string")
    got = sharding.assign(df).join(df, "doc_id")
    assert got.groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    per = got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(per) == 8 and max(r.b for r in per) < 1.1 * min(r.b for r in per) and max(r.n for r in per) < 1.5 * min(r.n for r in per)


def test_packing_against_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 100, (60, 3)).astype(float)
    got, left = sharding.pack(v, np.ones((4, 3)), v.sum(axis=0) / 4)
    room, want = np.ones((4, 3)) * sharding.WEIGHTS, {}
    unit = v / (v.sum(axis=0) / 4) * sharding.WEIGHTS
    for k in sorted(range(60), key=lambda k: (-unit[k].sum(), k)):
        want[k] = max(range(4), key=lambda s: (sum(room[s] * unit[k]), -s))
        room[want[k]] -= unit[k]
    assert got.tolist() == [want[k] for k in range(60)] and np.allclose(left * sharding.WEIGHTS, room)


def brute_repeats(rows, w):
    seen = collections.Counter(t[i : i + w] for _, t in rows for i in range(len(t) - w + 1))
    out = []
    for k, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                hit[i : i + w] = b"\1" * w
        runs = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((k, len(t), sum(hit), runs, hashlib.sha256(bytes(c for c, h in zip(t, hit) if not h)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [256, 4])
def test_suffix_dedup(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = documents.select("doc_id", "text").where("length(text) < 6000").union(spark.createDataFrame([(9001, "a" * 1000), (9002, None), (9003, "ab" * 300), (9003, "ab" * 300)], "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str) == brute_repeats(rows, 400)


def test_planted_passages_go_from_400_bytes_on(spark):
    """A passage of 51 words that two texts share goes whole if it has 400 bytes; the law leaves shorter ones."""
    rng = np.random.default_rng(5)
    words = lambda n, size: " ".join("".join(chr(c) for c in rng.integers(97, 123, size)) for _ in range(n))
    rows, want = [], {}
    for k, size in enumerate([5, 6, 7, 8, 9, 12] * 2):
        passage = words(51, size)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, f"{words(40, 6)} {d}<{passage}>{d % 2} {words(40, 6)}"))
            want[d] = len(passage) + 2 if len(passage) + 2 >= 400 else 0
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 0 < sum(x > 0 for x in want.values()) < len(want)


def test_suffix_arrays_decide_what_hashes_route():
    """Contexts under one key count as equal only where their bytes are."""
    same, other = b"xy" * 50 + b"z" * 310, bytes(range(1, 206)) * 2
    names = ["id", "tk", "start", "n_win", "n", "anchor", "context", "bytes"]

    def spans(*contexts):
        rows = [(k, k, 7, 11, n, anchor, 5, raw) for k, (n, anchor, raw) in enumerate(contexts)]
        table = pa.table([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows)], names)
        return [(r["n"], r["anchor"], r["lo"], r["hi"]) for r in suffix_dedup.shard_spans(table).to_pylist()]

    assert spans((3, 1, same), (3, 1, same)) == [(3, 1, 0, 11)]
    assert spans((3, 1, same), (3, 1, other)) == []
    assert spans((1, 1, same), (3, 2, same), (3, 2, same)) == [(1, 1, 7, 18), (3, 2, 0, 11)]


def test_suffix_dedup_on_odd_rows(odd):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(odd).collect()), key=str)
    small = [r for r in rows if len(r[1]) < 1000]
    assert [g for g in got if g[1] < 1000] == brute_repeats(small, 400)
    assert {g[0]: g[2] == g[1] for g in got if g[1] > 1000} == {6: True, 7: False}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert "kept_text" in suffix_dedup.remove_repeats(odd, texts=True).columns


def test_toxicity(spark, documents, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    bad, good = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean() > 0.85
    assert (good >= 0.3).mean() < 0.1
    strange = toxicity.score(odd, model, spans=True).collect()
    assert len(strange) == odd.count() and all(0 <= r.score <= 1 for r in strange)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0.01").count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def test_topk(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int) for r in rows}
    got = collections.defaultdict(list)
    for r in topk.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert dict(got) == {q: sorted((-int(x[q] @ x[k]), k) for k in x if k != q)[:5] for q in x if q % 50 == 0}
    strange = spark.createDataFrame([(0, [1.0, 0.5]), (50, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (None, [1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5])], "vec_id long, embedding array<float>")
    found = topk.top_k(strange, F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == {(0, 1, 5), (0, 2, 5), (0, 3, 50), (0, 4, None), (0, 5, 4), (50, 1, 0), (50, 2, 5), (50, 3, 5), (50, 4, None), (50, 5, 4)}
    assert topk.top_k(strange.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_licenses(documents, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, text in [(r, t.text) for r, t in zip(license_templates.labels(documents).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect())]:
        words = word.findall(low(text))
        at = sorted((k, l) for p, l in license_templates.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({l for _, l in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert license_templates.labels(odd).count() == odd.count()
    assert license_templates.matches(odd).count() == 0


def test_pii(odd):
    got = pii.digests(odd).collect()
    assert len(got) == odd.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.redact(odd).columns == odd.columns


def test_bpe(odd):
    path = queries.vocabulary_path()
    coded = bpe.decode(bpe.encode(odd, path), path)
    for r in coded.collect():
        assert r.decoded == (r.text or "") and len(r.token_ids) == len(r.token_offsets)
    assert {r.n_tokens for r in bpe.digests(odd.where("doc_id < 3"), path).collect()} == {0}


def brute_groups(rows, k, threshold=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                group[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, documents, k):
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w30".split()
    near = [(5000 + i, " ".join(base[: 30 - i % 7] + [f"x{i}"])) for i in range(60)] + [(6000, "W1 w2"), (6001, "w1 W2"), (6002, ""), (6003, None)]
    df = documents.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    want = brute_groups([(r.doc_id, r.text) for r in df.collect()], k)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(df, k).collect()} == want


def test_near_duplicates_on_odd_rows(odd):
    got = minhash_join.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.kept} == {1, 2, 3, 4, 6, None, 8}
    assert minhash_join.near_duplicates(odd.limit(0), 4).count() == 0
    kept = minhash_join.keep_one(odd, 5)
    assert kept.columns == odd.columns and kept.count() == 7


def test_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (-3, 200)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, -3: -3, 200: -3}
    assert components.components(edges.limit(0)).count() == 0


def test_decontamination(spark, documents, odd, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    items = {r.item_id: " " + " ".join(words(r.text)) + " " for r in benchmark.collect()}
    whole = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in " " + " ".join(words(r.text)) + " "}
    found = decontam.overlaps(documents, benchmark).collect()
    assert whole <= {(r.doc_id, r.item_id) for r in found} and whole
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 50)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(documents, benchmark).collect()} == {(r.doc_id, r.item_id) for r in found}
    assert decontam.overlaps(odd, benchmark).count() == 0
    assert decontam.overlaps(odd, benchmark.limit(0)).count() == 0
    short = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "item_id long, text string")
    assert decontam.keep_clean(odd, short).count() == odd.count()


def test_fixity(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert {r.verdict for r in fixity.audit(pages, pages).collect()} == {"ok"}
    got = {r.page_id: r.verdict for r in fixity.audit(pages, fixity.damaged(pages)).collect()}
    for i, verdict in got.items():
        if i % 389 == 7:
            assert verdict == "missing"
        elif i % 97 == 5:
            assert verdict == "corrupt"
    extra = fixity.audit(fixity.damaged(pages), pages).where("verdict = 'extra'")
    assert {r.page_id % 389 for r in extra.collect()} == {7}
    strange = spark.createDataFrame([(None, None, None), (None, "u", "x"), (1, "u", None), (1, "u", None), (-5, "", "")], "page_id long, url string, html string").withColumn("segment", F.lit(1))
    assert [r.verdict for r in fixity.audit(strange, strange).collect()] == ["ok"] * 5
    assert fixity.audit(strange.limit(0), strange.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "pii", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) < docs.count() and len({r.doc_id for r in got}) == len(got)
    assert all(len(r.token_ids) == r.n_tokens for r in got)
