"""Kernels against plain Python."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe, decontam, license_templates, pii, suffix_dedup, topk, toxicity
from tessera.llm import textkit as tk
from tessera.llm.suffix_arrays import permuted_prefixes, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def test_words_and_shingles():
    texts = ["a bb  ccc", "", " x", "y", "a bb"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends, ranges = tk.words(buf, bounds, tk.NOT_BLANK)
    found = [[bytes(buf[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(ranges, ranges[1:])]
    assert found == [t.split() for t in texts]
    hashes = tk.word_hashes(buf, starts, ends)
    assert hashes[0] == hashes[5] and len(set(hashes.tolist())) == 5
    values, at = tk.shingles(hashes, ranges, 2)
    assert np.diff(at).tolist() == [2, 0, 1, 1, 1] and values[0] == values[4]


def test_parts_cover_all_rows_and_nulls():
    col = pa.array(["ab", None, "", "cde" * 10, "f"])
    got = [bytes(buf[a:b]).decode() for _, _, buf, bounds in tk.parts(col.slice(1), 8) for a, b in zip(bounds, bounds[1:])]
    assert got == ["", "", "cde" * 10, "f"]


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.r_[rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 50))), 0].astype(np.uint16)
        sa = suffix_array(x, 1000)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        want = np.zeros(len(x), int)
        for a, b in zip(sa, sa[1:]):
            while b + want[b] < len(x) and a + want[b] < len(x) and x[a + want[b]] == x[b + want[b]]:
                want[b] += 1
        assert permuted_prefixes(x, sa, 100, np.zeros(0, int)).tolist() == want.tolist()


def test_ranks_are_final_once_they_are_alone(monkeypatch):
    """Of a text whose substrings differ but for one copied stretch, only the copies are sorted more than twice."""
    rng = np.random.default_rng(2)
    stretch = rng.integers(1, 200, 600)
    x = np.r_[rng.integers(1, 200, 20000), 201, stretch, 202, rng.integers(1, 200, 20000), 203, stretch, 204, 0].astype(np.uint8)
    rows, true = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *b, **c: (rows.append(len(a)) if a.dtype == np.int64 else None, true(a, *b, **c))[1])
    sa = suffix_array(x, len(x))
    raw = x.tobytes()
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: raw[i:])
    assert len(rows) > 2 and all(n < 1000 for n in rows[1:-1])


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_long_prefixes_are_found_alike(kind):
    """Prefixes of at least so many letters are exact, shorter ones stay short; letters need not fit a byte."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        part, top = rng.integers(1, 3, int(rng.integers(1, 60))), 200 if kind is np.uint8 else 1000
        x = np.r_[part, top, rng.integers(1, 3, 20), part, top + 1, part[:40], 0].astype(kind)
        sa = suffix_array(x, len(x))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        want = permuted_prefixes(x, sa, 100, np.zeros(0, int))
        got = permuted_prefixes(x, sa, 100, np.zeros(0, int), 12)
        assert np.where(want < 12, 0, want).tolist() == np.where(got < 12, 0, got).tolist()


def test_contexts_that_share_an_anchor_only_are_not_sorted():
    """Of texts with one passage in common a window repeats only where it reaches far enough."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        seam = bytes(rng.integers(97, 123, int(rng.integers(380, 500))).astype(np.uint8))
        texts = [bytes(rng.integers(65, 91, int(rng.integers(0, 500))).astype(np.uint8)) + bytes([33 + k]) + seam + bytes([33 + k]) + bytes(rng.integers(48, 58, 500).astype(np.uint8)) for k in range(3)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(range(3)), pa.array(texts, pa.binary())], ["id", "tk", "text"])
        rows = [r | {"n": 1, "context": r["id"], "bytes": texts[r["id"]][r["start"] : r["start"] + r["n_win"] + 399]} for b in suffix_dedup.anchor_batches(iter([batch])) for r in b.to_pylist()]
        times = collections.Counter(r["anchor"] for r in rows)
        table = pa.table({c: [r[c] for r in rows if times[r["anchor"]] > 1] for c in suffix_dedup.PIECE_COLUMNS}, pa.schema([(c, pa.binary() if c == "bytes" else pa.int64()) for c in suffix_dedup.PIECE_COLUMNS]))
        found = sorted((r["id"], r["lo"], r["hi"]) for r in suffix_dedup.shard_spans(table).to_pylist())
        assert {k: sum(hi - lo for i, lo, hi in found if i == k) for k in range(3)} == dict.fromkeys(range(3), max(0, len(seam) - 399))
    far = [bytes(rng.integers(a, a + 20, 300).astype(np.uint8)) + seam[:32] + bytes(rng.integers(a, a + 20, 300).astype(np.uint8)) for a in (40, 70, 100)]
    anchor = suffix_dedup.grams_of(tk.prefix_sums(np.frombuffer(seam[:32], np.uint8))).view(np.int64)
    assert suffix_dedup.may_repeat([*far, far[0]], np.repeat(anchor, 4)).tolist() == [True, False, False, True]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "漢", "😀", "!", "_", "́", "\x85", "Ⅷ"]
    texts = ["", " ", "x" * 5000, "=" * 700, *("".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500))]
    vocab = bpe.vocabulary(path)
    for text, pieces in zip(texts, bpe.encoded(pa.array(texts), vocab)):
        assert [int(i) for p in pieces for i in p[0].split()] == own.encode_ordinary(text)
        assert b"".join(p[1] for p in pieces).decode() == text
    batch = next(bpe.digest_batches(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["don't stop"])], ["a", "b"])]), path))
    assert batch.column(3)[0].as_py() == hashlib.sha256(b"don't stop").hexdigest()


def test_base_spans_equal_the_patterns():
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(text):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if [True, all(int(q) <= 255 for q in m[0].split(".")) if k == 1 else False, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                    out.append((m.start(), m.end(), k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    rng = random.Random(2)
    for text in ["", "a@b.c.d@e.f", "4111 1111-1111 1111", "+1 (714) 555-9345", "1.2.3.4.5.6.7.8", *("".join(rng.choices("a1.@-+ ()%_é2", k=rng.randint(0, 50))) for _ in range(3000))]:
        assert pii.base_spans(text) == plain(text)


def test_trees_select_secrets_and_leave_plain_numbers():
    model = pii.selector()
    kinds = lambda text: [pii.KINDS[k] for _, _, k in pii.find(text, model)[1]]
    assert kinds('set token = "59b79a44c83160ff605db5295c3f1b8f59a30bf7" now') == ["secret"]
    assert kinds("mail a.b@c.org from 10.0.0.1") == ["email", "ip"]
    assert kinds("order 123 of 2024-01-02 cost 17.50") == []
    assert pii.cover("call a@b.co now", pii.find("call a@b.co now", model)[1]) == "call [EMAIL] now"


def test_segments_are_maximal():
    scores = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    found = sorted((a, b, s) for a, b, s in toxicity.segments(scores))
    assert found == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.segments(np.array([-1.0, -2.0])) == []


def test_templates_need_the_mandatory_wording():
    auto = license_templates.build("x-{v}", "<<optional>>this <<var:thing:1-2>> is<<end>> licensed under foo version <<var:v:1-1>>")
    accept = lambda t: auto.accept(t.split(), 0)
    assert accept("this big work is licensed under foo version 3 or later") == (9, {"thing": "work", "v": "3"})
    assert accept("licensed under foo version 2")[1] == {"v": "2"}
    assert accept("licensed under the foo version 2") is None
    assert accept("this is licensed under foo version 2") is None


def test_substitutions_are_tolerated():
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo".split()
    block = decontam.Block([7], [" ".join(item)])
    changed = [w if k not in (5, 12) else "zzz" for k, w in enumerate(item)]
    texts = ["start " + " ".join(changed) + " stop", " ".join(item[:8]) + " nothing else of it", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["doc_id", "text"])
    got = next(decontam.overlap_batches(iter([batch]), block)).to_pylist()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_match"]) for r in got] == [(1, 7, 1, 16)]


def test_search_is_exact_with_ties_and_large_values():
    rng = np.random.default_rng(5)
    c = np.floor(rng.normal(size=(700, 9)) * 3) * rng.integers(1, 60, (700, 1))
    c[100:200] = c[0]
    ids = rng.permutation(700)
    turn = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    q = c[:40]
    at, found, scores = topk.search(ids[:40], q, np.full(40, -np.inf), ids, c, turn, 5)
    for k in range(40):
        want = sorted((-int(q[k] @ c[j]), int(ids[j])) for j in range(700) if ids[j] != ids[k])[:5]
        assert sorted((-int(s), int(i)) for a, i, s in zip(at, found, scores) if a == k) == want
    assert topk.dots(np.array([[2.0**62, 2.0**62]]), np.array([[4.0, 4.0]]))[0] == 2**63 - 1
