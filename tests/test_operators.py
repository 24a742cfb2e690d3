"""Hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import coherence as co
from tessera.operators import evaluation as ev
from tessera.operators import learning as ln
from tessera.operators import matrix as mx
from tessera.operators import mentions as mn
from tessera.operators import ranking as rk
from tessera.operators import tokens as tk
from tessera.sources import readers, writers
from tessera.streaming.incremental import follow, unprocessed


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_islands(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "pos int, label int")
    out = rk.islands(df.withColumn("g", F.lit(0)), ["g"], [F.asc("pos")], "label")
    assert [r["count"] for r in out.groupBy("island").count().orderBy("island").collect()] == [2, 2]


def test_block_join(spark):
    a = spark.createDataFrame([(2, 0, 0.1, 1), (1, 0, 0.3, 1), (1, 1, 0.4, 0), (3, 0, 1.0, 1), (3, 1, 2.0, 0)], "qid int, pos int, fa double, label int")
    b = spark.createDataFrame([(1, 0, 0.0, 1), (1, 1, 4.0, 0), (2, 0, 1.0, 1), (3, 0, 0.1, 1), (3, 1, 0.2, 0)], "qid int, pos int, fb double, label int")
    out = mx.join_blocks(a, b, ["qid", "pos"]).select("qid", "fa", "fb", "label")
    assert rows(out) == [(1, 0.3, 0.0, 1), (1, 0.4, 4.0, 0), (2, 0.1, 1.0, 1), (3, 1.0, 0.1, 1), (3, 2.0, 0.2, 0)]


def test_token_statistics(spark):
    docs = spark.createDataFrame([("q", "e1", "x x y"), ("q", "e2", "x y"), ("q", "e3", "y"), ("q", "e4", "z")], "q string, e string, text string")
    n = tk.counts(docs, ["q"], "e")
    got = {r.token: r for r in tk.spread(n, docs, ["q"]).collect()}
    for token, df, idf, h in (("x", 2, 0.301030, 0.946395), ("y", 3, 0.124939, 0.811278), ("z", 1, 0.602060, 0.811278)):
        assert got[token].df == df
        assert got[token].idf == pytest.approx(idf, abs=1e-6)
        assert got[token].entropy == pytest.approx(h, abs=1e-6)
    raw = {r.token: r.entropy for r in tk.spread(n, docs, ["q"], normalized=False).collect()}
    assert raw["x"] == pytest.approx(0.451545, abs=1e-6)
    tf = {(r.e, r.token): r.tf for r in tk.term_frequency(n, ["q"], "e").collect()}
    assert tf["e1", "x"] == pytest.approx(2 / 3)


def test_links(spark):
    edges = spark.createDataFrame([(x, "s") for x in "abcd"] + [(x, "t") for x in "bce"], "src string, dst string")
    pairs = spark.createDataFrame([("t", "s")], "entity string, other string")
    row = co.similarities(co.pair_links(pairs, edges), sim.UNIVERSE).first()
    assert (row.pmi, row.ngd, row.njs) == pytest.approx((2 / 3, 0.952372, math.log(3) / math.log(6)), abs=1e-6)
    none = co.similarities(co.pair_links(spark.createDataFrame([("s", "u")], "entity string, other string"), edges), sim.UNIVERSE).first()
    assert (none.pmi, none.ngd) == (0.0, 0.0)


def test_strings(spark):
    df = spark.createDataFrame([("Paris", "Paris_Saint-Germain")], "m string, e string").select(tx.normalize_mention(F.col("m")).alias("m"), tx.normalize_mention(F.col("e")).alias("e"))
    got = df.select(*(c.alias(k) for k, c in sim.string_features(F.col("m"), F.col("e")).items())).first()
    assert got.es == pytest.approx(1 - 14 / 19) and (got.start_with, got.end_with, got.same) == (1, 0, 0)
    swapped = df.select(*(c.alias(k) for k, c in sim.string_features(F.col("e"), F.col("m")).items())).first()
    assert set(swapped) == {0.0}
    assert one(spark, sim.jaro_winkler(F.lit("martha"), F.lit("marhta"))) == pytest.approx(0.961111, abs=1e-6)
    assert one(spark, sim.jaro_winkler(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, sim.hamming_similarity(F.lit("abc"), F.lit("abdd"))) == pytest.approx(0.5)


def test_mention_forms(spark):
    forms = spark.createDataFrame([("NYC",), ("paris",), ("U.S. OPEN",), ("Open",)], "m string")
    got = {r.m: (r.a, r.b) for r in forms.select("m", tx.normalize_form(F.col("m")).alias("a"), tx.fix_upper_case(F.col("m")).alias("b")).collect()}
    assert got["NYC"][0] == "NYC" and got["paris"][0] == "PARIS"
    assert got["U.S. OPEN"][1] == "U S Open" and got["Open"][1] == "Open"
    escaped = spark.createDataFrame([("Caf\\u00e9",), ("plain",), (None,)], "e string").select(tx.unescape_entity(F.col("e")).alias("e"))
    assert {r.e for r in escaped.collect()} == {"Café", "plain", None}


@pytest.mark.parametrize(("extra", "expected"), [([("John Smith", 40, 0), ("John Smith", 130, 1), ("Smithson", 90, 2), ("Smi", 99, 3)], "Smithson"), ([("John Smith", 40, 0), ("Smithson", 90, 1), ("Will Smith", 100, 2)], "Will Smith"), ([("John Smith", 130, 0)], "John Smith"), ([], "Smith")])
def test_nearest(spark, extra, expected):
    surfaces = spark.createDataFrame([("d", *x) for x in extra], "doc_id string, surface string, at int, seq int")
    mention = spark.createDataFrame([(1, "d", "Smith", 100)], "query_id int, doc_id string, mention string, offset int")
    assert mn.nearest_related(mention, surfaces).first().surface == expected


def test_evaluation(spark):
    df = spark.createDataFrame([("q1", 0, 0.9, 1), ("q1", 1, 0.5, 0), ("q1", 2, 0.1, 0), ("q2", 0, 0.4, 1), ("q2", 1, 0.7, 0), ("q3", 0, 0.6, 1), ("q3", 1, 0.6, 0)], "query_id string, pos int, score double, label int")
    got = ev.precision_recall(df, spark.createDataFrame([(5,)], "total long")).first()
    assert (got.n_correct, got.p, got.r, got.f1) == pytest.approx((1, 1 / 3, 1 / 5, 0.25))
    assert rows(rk.gold_rank(df, "query_id", "score", "label")) == [("q1", 1), ("q2", 2), ("q3", 1)]
    first = rk.argmax(df.withColumn("entity", F.col("pos")), "query_id", "score", "pos", "entity")
    assert {r.query_id: r.entity for r in first.collect()} == {"q1": 0, "q2": 1, "q3": 0}
    assert ev.precision_recall(df.where("query_id = 'q2'"), spark.createDataFrame([(0,)], "total long")).first().f1 == 0.0


def test_windows_and_matrix(spark):
    docs = spark.createDataFrame([(1, "a b c target d e f"), (2, "target")], "doc_id int, text string")
    near = tk.context_windows(docs, ["doc_id"], spark.createDataFrame([("target",)], "token string"), 2)
    assert [r.token for r in near.orderBy("pos").collect()] == ["b", "c", "d", "e"]
    key = mx.parse_key(spark.createDataFrame([("(12, 'Some_Entity')",)], "k string"), "k").first()
    assert (key.query_id, key.entity) == (12, "Some_Entity")
    cells = spark.createDataFrame([("r", "c1", 1), ("r", "c2", 0)], "row string, col string, value int")
    assert mx.as_json(cells, "row", "col", "value").first().json == '{"row":"r","cells":[{"col":"c1","value":1},{"col":"c2","value":0}]}'


def test_ranker_learns_order(spark):
    df = spark.createDataFrame([(q, p, float(p == q % 3) + 0.01 * p, float(q), int(p == q % 3)) for q in range(30) for p in range(3)], "query_id int, pos int, a double, b double, label int")
    model = ln.train_pairwise(ln.pairwise_rows(df, ["a", "b"]), ["a", "b"])
    top = rk.argmax(model.score(df).withColumn("entity", F.col("label")), "query_id", "predicted", "pos", "entity")
    assert {r.entity for r in top.collect()} == {1}
    drawn, left = ln.bootstrap(spark.range(1000).withColumnRenamed("id", "d"), "d", 3)
    assert drawn.count() + left.count() == 1000 and 300 < left.count() < 440


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<corpus><document docName="d1"><annotation><mention>Paris</mention><wikiName>Paris France</wikiName><offset>3</offset><length>5</length></annotation><annotation><mention>X</mention><wikiName></wikiName><offset>x</offset><length>1</length></annotation></document></corpus>')
    assert rows(readers.annotated_xml(spark, str(tmp_path / "c.xml")), "surfaceform") == [("d1", "Paris", "Paris_France", 3, 5), ("d1", "X", "none", None, 1)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "d1.txt").write_text("a\nb")
    assert rows(readers.whole_texts(spark, str(tmp_path / "t"))) == [("d1", "a\nb")]
    assert [r.value for r in readers.lines(spark, str(tmp_path / "t" / "d1.txt")).collect()] == ["a", "b"]
    (tmp_path / "f.svm").write_text("1 1:0.5 3:2\n0 2:1\n")
    assert readers.libsvm(spark, str(tmp_path / "f.svm"), 3).count() == 2
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    writers.put_if_absent(table, str(tmp_path / "out"), ["k"])
    writers.put_if_absent(spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string"), str(tmp_path / "out"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    shaped = readers.shaped(spark.createDataFrame([(i, str(i)) for i in range(4)], "i int, v string"), ["i"], "v", 2)
    assert [r.cells for r in shaped.orderBy("row").collect()] == [["0", "1"], ["2", "3"]]


def test_resumable_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    run = lambda: follow(spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in")), lambda b: b, str(tmp_path / "out"), ["k"], str(tmp_path / "cp")).awaitTermination(60)
    assert run()
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert rows(done) == [(1, "a"), (2, "b"), (3, "c")]
    assert unprocessed(spark.createDataFrame([(3, "x"), (4, "y")], "k int, v string"), done, ["k"]).count() == 1


def test_markup_keeps_plain_text(spark):
    text = "== Early life | 1 ==\n== Notes (a) ==\nsee http://a.org/b/c/ and /pa\u0259/ here\nor/and/so\n\n\nend"
    assert one(spark, tx.strip_markup(F.lit(text))) == "\n== Notes (a) ==\nsee http: here\nor/and/so\nend"


def test_spans_have_all_places(spark):
    df = spark.createDataFrame([(1, "Ann met New York and Ann. New York"), (2, "nobody"), (3, None)], "doc_id long, text string")
    assert rows(mn.capitalised_spans(df), "doc_id", "start") == [(1, "Ann", 0), (1, "New York", 8), (1, "Ann", 21), (1, "New York", 26)]


def test_unknown_query():
    from tessera.plans import registry

    with pytest.raises(ValueError):
        registry.chosen("no such query")
