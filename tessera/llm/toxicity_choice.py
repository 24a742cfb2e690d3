"""How toxicity's constants are chosen: cross-validation inside the rows whose labels may be read.

    python -m tessera.llm.toxicity_choice FOLDER

reads ``documents`` and ``labels`` of FOLDER, drops the held-out rows before anything else, and prints
log loss and AUC over FOLDS folds for each setting, the best log loss first.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from multiprocessing import Pool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.llm import toxicity

FOLDS = 4
GRID = {"PRIOR_SHARE": (0.1, 0.5, 2.0), "SHRINK": (0.0, 0.75, 1.5), "DRIFT": (0.5, 1.0, 2.0), "TOP": (4.0, 6.0, 9.0)}

_rows: list[tuple[int, int, pa.RecordBatch]] = []


def training_rows(folder: str) -> pd.DataFrame:
    """(text, toxic, remainder) of labelled documents that are not held out."""
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pandas().dropna()
    labels["crc"] = [zlib.crc32(str(int(x)).encode()) for x in labels.doc_id]
    labels = labels[labels.crc % 4 != 2].groupby("doc_id", as_index=False).max().sort_values("crc").head(toxicity.SAMPLE_ROWS)
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"], filters=[("doc_id", "in", labels.doc_id.tolist())]).to_pandas()
    return docs.merge(labels, on="doc_id")


def batch_of(rows: pd.DataFrame) -> pa.RecordBatch:
    half = (rows.crc // 64 % 2).to_numpy(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(rows.text, pa.string()), pa.array(half), pa.array((rows.toxic > 0).to_numpy(np.int32))], ["text", "half", "toxic"])


def fold_scores(train: pa.RecordBatch, test: pa.RecordBatch) -> np.ndarray:
    table = next(toxicity.count_batches(iter([train]))).to_pandas()
    model, halves = toxicity.tables_of(table[table[["n0", "n1", "n2", "n3"]].sum(axis=1) > 1])
    toxicity.fit_law(model, next(toxicity.best_batches(iter([train]), halves)).to_pandas())
    toxicity.fit_curve(model, next(toxicity.evidence_batches(iter([train]), halves, model)).to_pandas())
    rows = pa.RecordBatch.from_arrays([pa.nulls(len(test), pa.int64()), test.column(0)], ["doc_id", "text"])
    return next(toxicity.score_batches(iter([rows]), model)).column(1).to_numpy()


def measure(setting: tuple[float, ...]) -> tuple[float, float, tuple[float, ...]]:
    """(log loss, AUC, setting) over all folds."""
    for name, value in zip(GRID, setting):
        setattr(toxicity, name, value)
    labels, scores = [], []
    for train, test in _rows:
        labels.append(test.column(2).to_numpy())
        scores.append(fold_scores(train, test))
    y, p = np.concatenate(labels), np.clip(np.concatenate(scores), 1e-6, 1 - 1e-6)
    rank = pd.Series(p).rank().to_numpy()
    n1 = y.sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), float(auc), setting


def main(folder: str) -> None:
    rows = training_rows(folder)
    fold = (rows.crc // 4 % FOLDS).to_numpy()
    _rows.extend((batch_of(rows[fold != f]), batch_of(rows[fold == f])) for f in range(FOLDS))
    with Pool() as pool:
        found = sorted(pool.imap_unordered(measure, itertools.product(*GRID.values())))
    print(len(rows), "rows", int((rows.toxic > 0).sum()), "toxic;", ", ".join(GRID))
    for loss, auc, setting in found:
        print(f"{loss:.4f} {auc:.4f}", *setting)


if __name__ == "__main__":
    main(sys.argv[1])
