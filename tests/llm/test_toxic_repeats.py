"""Toxic passages that are repeated in a text."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.llm import toxicity


def passages(texts, bad, model=None):
    """Significant passages with a table in which only the words of ``bad`` are toxic."""
    table = np.full(toxicity.SLOTS, -1, np.float32)
    slots = toxicity.word_slots(np.frombuffer(bad.encode(), np.uint8), np.array([0, len(bad)]))[0]
    table[slots[0]] = 3
    model = toxicity.Model(table, 1.0, 0.0, np.array([-2.0, 0, 1, 0]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    return next(toxicity.score_batches(iter([batch]), model, spans=True))


def test_every_repeated_passage_counts():
    bad = "gron vash mulk drez pofa kuth"
    clean = " ".join(f"calm{k}" for k in range(60))
    texts = [" ".join([clean, bad] * n + [clean]) for n in (1, 2, 3, 6)]
    got = passages(texts, bad)
    for text, n, found in zip(texts, (1, 2, 3, 6), got.column(2).to_pylist()):
        assert sorted(text[p["start"] : p["end"]] for p in found) == [bad] * n
    scores = got.column(1).to_pylist()
    assert scores == sorted(scores) and scores[0] < scores[-1]


@pytest.mark.parametrize("drift", [0.5, 1.0, 2.0])
def test_curve_sees_all_segments(monkeypatch, drift):
    monkeypatch.setattr(toxicity, "DRIFT", drift)
    text = " ".join(["gron"] * 3 + ["calm"] * 40) + " "
    texts = [text * 80]
    table = np.full(toxicity.SLOTS, -1, np.float32)
    table[toxicity.word_slots(np.frombuffer(b"gron", np.uint8), np.array([0, 4]))[0][0]] = 6
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0], pa.int32()), pa.array([1], pa.int32())], ["text", "half", "toxic"])
    model = toxicity.Model(table, 1.0, 0.0, np.zeros(4))
    row = next(toxicity.evidence_batches(iter([batch]), [table, table], model)).column(1)[0].as_py()
    assert np.isclose(np.expm1(row[2]), 80 * (3 * (6 - drift) - np.log(80 * 43)))


def test_law_of_clean_texts_does_not_depend_on_batches():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["gron", "calm", "vell", "ost"], int(n))) for n in rng.integers(0, 60, 40)]
    table = rng.normal(-0.4, 1, toxicity.SLOTS).astype(np.float32)
    toxic = rng.integers(0, 2, 40)
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(40) % 2, pa.int32()), pa.array(toxic, pa.int32())], ["text", "half", "toxic"])
    laws = []
    for size in (40, 7, 1):
        sums = [b.to_pandas() for b in toxicity.best_batches(iter([rows.slice(k, size) for k in range(0, 40, size)]), [table, table])]
        model = toxicity.Model(table, 1.0, 0.0, np.zeros(4))
        toxicity.fit_law(model, pd.concat(sums[::-1]))
        laws.append((model.scale, model.log_k))
    assert laws[0] == laws[1] == laws[2]
    tops = []
    for own, bad in zip((own for _, own in next(toxicity.halves_scored(iter([rows]), [table, table]))), toxic):
        if not bad:
            best = max((sum(own[a:b].tolist()) for a in range(len(own)) for b in range(a + 1, len(own) + 1)), default=0.0)
            tops.append(laws[0][0] * max(0.0, best) - np.log(max(1, len(own))))
    assert np.isclose(laws[0][1], np.mean(tops) - np.euler_gamma, atol=1e-5)
