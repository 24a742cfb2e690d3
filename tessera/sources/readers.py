"""Scans with explicit schemas: filters and columns reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MENTIONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("doc_id", T.StringType()), T.StructField("surfaceform", T.StringType()), T.StructField("length", T.StringType()), T.StructField("begoffset", T.StringType()), T.StructField("annotation", T.StringType()), T.StructField("type", T.StringType()), T.StructField("doc_text", T.StringType()), T.StructField("wiki_url", T.StringType())])
ANNOTATIONS = T.StructType([T.StructField("_docName", T.StringType()), T.StructField("annotation", T.ArrayType(T.StructType([T.StructField("mention", T.StringType()), T.StructField("wikiName", T.StringType()), T.StructField("offset", T.StringType()), T.StructField("length", T.StringType())])))])


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a task of tables that are dealt out for sorts and groups.
ROWS_A_PART = 1 << 19


def dealt_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by keys, in parts of about ROWS_A_PART of its ``rows`` however large the table, so that a task's memory stays; small tables are left to Spark."""
    parts = rows // ROWS_A_PART
    return df if parts < 2 else df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), *keys)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key stands in a list of ids, each as often as it is in ``df``."""
    return df.join(ids.select(key), key, "left_semi")


def surface_forms(df: DataFrame, kind: str) -> DataFrame:
    """Surface forms of a corpus part's linked mentions, in their own column."""
    return mentions(df, kind).select("surfaceform")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``df`` with a value by key, or the default: many point lookups as one join."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def feature_rows(spark: SparkSession, path: str, exp: str, source: str, kind: str) -> DataFrame:
    """The rows of one experiment, source and type: one partition of the table."""
    return spark.read.parquet(path).where((F.col("exp") == exp) & (F.col("source") == source) & (F.col("kind") == kind))


def with_raw_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotations beside the raw text of their document."""
    return rows.join(texts, "doc_id", "left")


def entity_spans(df: DataFrame, column: str) -> DataFrame:
    """(doc_id, sentence, start, end, ner, text) of a recogniser's JSON answers."""
    schema = "struct<sentences:array<struct<index:int,entitymentions:array<struct<tokenBegin:int,tokenEnd:int,ner:string,text:string>>>>>"
    rows = df.select("doc_id", F.explode(F.from_json(column, schema)["sentences"]).alias("s"))
    rows = rows.select("doc_id", F.col("s.index").alias("sentence"), F.explode("s.entitymentions").alias("m"))
    return rows.select("doc_id", "sentence", F.col("m.tokenBegin").alias("start"), F.col("m.tokenEnd").alias("end"), "m.ner", "m.text")


def coref_chains(df: DataFrame, column: str) -> DataFrame:
    """(doc_id, chain, sentence, start, end, text, is_representative) of a coreference service's JSON answers."""
    schema = "struct<corefs:map<string,array<struct<sentNum:int,startIndex:int,endIndex:int,text:string,isRepresentativeMention:boolean>>>>"
    rows = df.select("doc_id", F.explode(F.from_json(column, schema)["corefs"]).alias("chain", "mentions")).select("doc_id", F.col("chain").cast("int").alias("chain"), F.explode("mentions").alias("m"))
    return rows.select("doc_id", "chain", (F.col("m.sentNum") - 1).alias("sentence"), (F.col("m.startIndex") - 1).alias("start"), (F.col("m.endIndex") - 1).alias("end"), "m.text", F.col("m.isRepresentativeMention").alias("is_representative"))


def mentions(df: DataFrame, kind: str, low: int | None = None, high: int | None = None, keep_nil: bool = False) -> DataFrame:
    """Annotated mentions of a type, optionally in a range of ids (both ends included)."""
    out = df.where((F.col("type") == kind) & ~F.col("annotation").isin("none") if keep_nil else (F.col("type") == kind) & ~F.col("annotation").isin("none", "NIL"))
    return out if low is None else out.where(F.col("id").between(low, high))


def annotated_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotation of a corpus file; names get underscores, empty ones are 'none'."""
    docs = spark.read.format("xml").option("rowTag", "document").schema(ANNOTATIONS).load(path)
    rows = docs.select(F.col("_docName").alias("doc_id"), F.explode("annotation").alias("a"))
    name = F.coalesce(F.nullif(F.replace(F.trim(F.coalesce("a.wikiName", F.lit(""))), F.lit(" "), F.lit("_")), F.lit("")), F.lit("none"))
    return rows.select("doc_id", F.col("a.mention").alias("surfaceform"), name.alias("annotation"), F.expr("try_cast(a.offset as int)").alias("begoffset"), F.expr("try_cast(a.length as int)").alias("length"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each file, named after it."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1).alias("doc_id"), F.col("value").alias("text"))
    return raw


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def libsvm(spark: SparkSession, path: str, features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", str(features)).load(path)


def json_value(df: DataFrame, column: str, schema: str, default: str) -> DataFrame:
    """A JSON column as typed values, with a default for what is missing."""
    return df.withColumn(column, F.coalesce(F.from_json(column, schema), F.from_json(F.lit(default), schema)))


def shaped(df: DataFrame, order: list[str], value: str, n: int) -> DataFrame:
    """Every n lines make a row: place decides, by an index column (0-based) that ``df`` carries."""
    return df.groupBy(F.floor(F.col(order[0]) / n).alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order[0], value))), lambda x: x[value]).alias("cells"))
