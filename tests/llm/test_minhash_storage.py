"""What the near-duplicate join stores and shuffles beside its results."""

import random
from pathlib import Path

from tessera.llm import minhash_join
from tessera.llm.scratch import cut


def test_texts_without_near_copies_are_not_stored(spark, monkeypatch):
    rng, stored = random.Random(3), []

    def counted(df):
        out = cut(df)
        stored.append(sum(p.stat().st_size for p in Path(out.scratch_path.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(minhash_join, "cut", counted)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(2000)) for _ in range(200)]
    rows = [*enumerate(texts), (900, texts[0]), (901, texts[0]), (902, texts[1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(df, 4).collect()}
    assert got == {**{k: k for k in range(200)}, 900: 0, 901: 0, 902: 1}
    # zstd leaves more than half of such letters.
    assert max(stored) < 0.1 * sum(map(len, texts))


def test_equal_sets_of_different_texts(spark):
    """Copies by their texts, by their sets alone, and rows that share an id."""
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "red orange yellow green blue indigo violet black white grey pink brown"
    rows = [(4, a), (3, a.upper()), (9, a.replace(" ", "\n")), (9, a), (9, a), (7, a.upper()), (5, b), (5, a), (6, b.title()), (8, b), (None, a)]
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id} == {3} and [r.kept for r in got if r.doc_id is None] == [True]


def test_shingles_of_one_group_are_told_exactly(spark):
    """Shingles of one, two and three documents of a group and of another group; an id with two texts."""
    w = [f"w{k}" for k in range(100)]
    texts = [(1, 1, w[:40]), (2, 1, w[20:60]), (3, 1, w[30:50]), (4, 4, w[45:70]), (5, 5, w[80:]), (5, 5, w[70:90])]
    rows = spark.createDataFrame([(i, g, " ".join(t)) for i, g, t in texts], "doc_id long, g long, text string")
    lists = rows.selectExpr("doc_id as id", "g").distinct().withColumnRenamed("g", "g")
    stored = minhash_join.fetched(rows, cut(lists.select("id")), 4)
    sets = [(i, g, {tuple(t[j : j + 4]) for j in range(len(t) - 3)}) for i, g, t in texts]
    for threshold in (1, 10, 25, 50, 100):
        want = set()
        for i in {i for i, _, _ in sets}:
            own = [(g, s) for x, g, s in sets if x == i]
            foreign = sum(any(shingle in s2 for _, g2, s2 in sets if g2 != g) for g, s in own for shingle in s)
            if 100 * foreign >= threshold * min(len(s) for _, s in own):
                want.add(i)
        assert {r.id for r in minhash_join.able(cut(lists), stored, 4, threshold).collect()} == want
