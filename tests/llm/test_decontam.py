"""Benchmark passages: the acceptance rule against brute force."""

import random

import numpy as np

from tessera.llm import decontam


def accepted(words, own, first):
    """The rule of the module, stretch by stretch."""
    agree = [0 <= first + k < len(own) and own[first + k] == w for k, w in enumerate(words)]
    least = min(13, len(words))
    inside = [k for k in range(len(words)) if 0 <= first + k < len(own)]
    lo, hi = (inside[0], inside[-1] + 1) if inside else (0, 0)
    runs = any(5 * sum(agree[a:b]) > 4 * (b - a) for a in range(lo, hi) for b in range(a + least, hi + 1))
    return bool(words) and (runs or 10 * sum(agree) >= 7 * len(words))


def verdict(block, words, own, first):
    return block.judge(np.array([block.words[words.index(w)] if w in words else 1 for w in own], np.uint64), 0, first)


def test_stretch_longer_than_its_core():
    words = [f"w{k}" for k in range(38)]
    block = decontam.Block([1], [" ".join(words)])
    for same in ((12, 4), (10, 4), (4, 12), (6, 6), (12, 3)):
        own = ["x"] * 20 + words[5 : 5 + same[0]] + ["y"] + words[6 + same[0] : 6 + sum(same)] + ["z"] * 20
        got = verdict(block, words, own, 15)
        assert (got is not None) == accepted(words, own, 15), same
    own = ["x"] * 20 + words[5:17] + ["y"] + words[18:22] + ["z"] * 20
    assert verdict(block, words, own, 15) == (20, 37, 16)


def test_rule_at_random():
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.choice((1, 2, 5, 7, 12, 13, 16, 20, 38))
        words = [f"w{k}" for k in range(n)]
        cut, share = rng.randrange(n), rng.choice((0.1, 0.2, 0.3))
        own = [w if rng.random() > share else "x" for w in words][: rng.randrange(1, n + 1)]
        own = ["x"] * rng.randrange(3) + own if rng.random() < 0.5 else own[cut:]
        first = (len(own) - n) if rng.random() < 0.2 else -cut if own and own[0] in words and own[0] == words[cut] else 0
        block = decontam.Block([1], [" ".join(words)])
        assert (verdict(block, words, own, first) is not None) == accepted(words, own, first)


def held(texts, items):
    """(text, item) by the rule on every diagonal."""
    return {(d, i) for d, own in enumerate(texts) for i, words in enumerate(items) if any(accepted(words, own, f) for f in range(1 - len(words), len(own)))}


def found(texts, items):
    import pyarrow as pa

    block = decontam.Block(list(range(len(items))), [" ".join(x) for x in items])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(x) for x in texts])], ["doc_id", "text"])
    got = next(decontam.overlap_batches(iter([batch]), block))
    return set(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def test_masks_are_complete():
    """Every way to replace words in 13 to 25 words (and in 12) that leaves seven tenths has a masked hit, so every accepted passage has."""
    for n in range(decontam.MASKED_WORDS, 26):
        lost = n - decontam.whole_words(n)
        assert lost >= max(d for d in range(n) if 5 * (n - d) > 4 * n) and decontam.complete(decontam.MASKS, n, lost), n
    assert not all(decontam.complete(decontam.MASKS[:2], n, n - decontam.whole_words(n)) for n in range(12, 26)) and not decontam.complete(("111111",), 13, 2)


def test_every_accepted_alignment_has_a_masked_seed():
    rng = random.Random(3)
    for _ in range(2000):
        words = [f"w{k}" for k in range(rng.choice((12, 13, 14, 17, 20, 26, 30, 41, 64)))]
        own = ["x" if rng.random() < rng.choice((0.15, 0.3)) else w for w in words]
        if rng.random() < 0.4:
            cut = rng.randrange(len(words) - 12 + 1)
            own = ["x"] * cut + own[cut : cut + rng.randrange(12, 30)]
        if accepted(words, own, 0):
            agree = [k < len(own) and own[k] == w for k, w in enumerate(words)]
            assert any(all(agree[at + k] for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for at in range(len(words) - len(m) + 1))


def test_one_block_and_many_are_alike(spark, monkeypatch):
    rng = random.Random(21)
    items = [[f"w{n}x{k}" for k in range(n)] for n in (*range(0, 16), 20, 27, 38)] + [["the"] * 14, [rng.choice("ab") for _ in range(30)]]
    texts = []
    for words in items * 3:
        own = ["x" if rng.random() < 0.2 else w for w in words]
        texts.append([rng.choice("abcd") for _ in range(rng.randrange(6))] + own + ["the"] * rng.randrange(3))
    texts += texts[:5]
    docs = spark.createDataFrame([(d % 50, " ".join(t), d) for d, t in enumerate(texts)] + [(None, " ".join(items[15]), 0), (99, None, 0), (98, "", 0)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i % 18, " ".join(w)) for i, w in enumerate(items)] + [(1, None), (None, "a b c"), (3, " ".join(items[3]))], "item_id long, text string")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    one, kept = key(decontam.overlaps(docs, bench)), key(decontam.keep_clean(docs, bench))
    assert {(d, i) for d, i, *_ in one} >= {(d % 50, i % 18) for d, i in held(texts, items)} and len(one) > 40
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontam, "TOGETHER", 2)
    assert key(decontam.overlaps(docs, bench)) == one and key(decontam.keep_clean(docs, bench)) == kept
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 and decontam.keep_clean(docs.limit(0), bench).count() == 0
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 0)
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0 and decontam.keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_every_accepted_alignment_has_a_seed(monkeypatch):
    rng = random.Random(13)
    items = [[f"w{n}x{k}" for k in range(n)] for n in (*range(0, 31), 38, 50)]
    for limit in (1 << 18, 40):
        monkeypatch.setattr(decontam, "LAID_OUT", limit)
        texts = []
        for words in items:
            for _ in range(8):
                lost = rng.sample(range(len(words)), rng.randint(0, len(words) * 3 // 10 + 1) if words else 0)
                own = ["x" if k in lost else w for k, w in enumerate(words)]
                texts.append(["y"] * rng.randrange(4) + own[: rng.choice((len(own), 16))] + ["z"] * rng.randrange(4))
            # The sparsest accepted one: words replaced at even distances.
            d = len(words) * 3 // 10
            texts.append(["x" if any(k == (j + 1) * len(words) // (d + 1) for j in range(d)) else w for k, w in enumerate(words)])
        want = held(texts, items)
        assert found(texts, items) == want and len(want) > 200


def test_same_words_in_many_places():
    rng = random.Random(4)
    items = [[rng.choice("abc") for _ in range(n)] for n in (1, 2, 3, 4, 6, 9, 14, 20, 33)]
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(60)]
    assert found(texts, items) == held(texts, items)
