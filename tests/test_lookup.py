"""Point lookups open the files of their keys only."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import lookup as lk


def files_read(df):
    """Files that the scans of an executed query opened."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup"))
    rows = spark.range(4000).select((F.col("id") * 7).alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("bucket"))
    rows = rows.union(spark.createDataFrame([(14, "again", 2), (None, "no key", 3)], "k long, v string, bucket int"))
    lk.write_indexed(rows, path, "k", 32)
    return lk.Lookup(spark, path, "k", "bigint", 32)


def test_rows_and_files(table):
    assert files_read(table.table.select("v")) == 32
    one = table.values([14])
    assert sorted(r.v for r in one.collect()) == ["again", "v2"] and files_read(one) == 1
    some = table.values([0, 7, 7, 13, 27993])
    assert sorted((r.k, r.v) for r in some.collect()) == [(0, "v0"), (7, "v1"), (27993, "v3999")] and files_read(some) <= 4
    assert table.values([]).count() == 0 and table.values([-1]).count() == 0 and table.values([None]).count() == 0
    assert table.value(7, "v") == "v1" and table.value(8, "v", "none") == "none" and "_bucket" not in one.columns


def test_keys_of_a_table_prune_too(spark, table):
    keys = spark.createDataFrame([(7, "a"), (8, "b"), (None, "c")], "k long, tag string")
    found = table.joined(keys)
    assert sorted((r.k, r.tag, r.v) for r in found.collect()) == [(7, "a", "v1")]
    every = table.joined(keys, {"v": "none"})
    assert sorted(((r.k, r.tag, r.v) for r in every.collect()), key=str) == [(7, "a", "v1"), (8, "b", "none"), (None, "c", "none")]
    pruned = table.joined(F.broadcast(keys.where("tag = 'a'")))
    assert files_read(pruned) <= 2


def test_text_keys_and_empty_tables(spark, tmp_path):
    lk.write_indexed(spark.createDataFrame([("é", 1), ("", 2)], "name string, n int"), str(tmp_path), "name", 4)
    t = lk.Lookup(spark, str(tmp_path), "name", "string", 4)
    assert t.value("é", "n") == 1 and t.value("", "n") == 2 and t.value("e", "n", 0) == 0
