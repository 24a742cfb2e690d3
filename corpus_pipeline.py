"""From raw documents to token ids: five stages, each written as Parquet before the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of
documents.  Edge cases are those of the operators they call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, minhash_join, pii, toxicity
from tessera.llm.queries import table, vocabulary_path
from tessera.llm.scratch import cut

#: Trees over generated examples, exact sets and BPE have no SQL form.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic; the model learns from the labels that are not held out."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out()))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five-word shingles."""
    return minhash_join.keep_one(docs, k=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    out = bpe.encode(docs, vocabulary_path(), offsets=False)
    return out.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES = [("toxicity", toxic), ("minhash_near_dedup", near_copies), ("decontamination", decontaminated), ("pii", redacted), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
