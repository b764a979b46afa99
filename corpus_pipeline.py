"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are blacked
out, sources are mixed to their target weights, and the rest is packed into sequences.

Defined results: null texts pass every stage (score the leak, class of their own, no secret, size 0, the lone end
token), the mix takes them once or not at all as it does other rows without words; n_chars follows a blacked-out text;
of repeated rows one stays, by least doc_id, null last, ties by the table's order; columns beyond those of documents are
kept up to the mix, whatever their names; empty documents give an empty result; very long texts stay one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import mixing, near_duplicates, packing, secrets, toxicity
from quillspan.llm.common import learnable, small_batches, written

#: Stands in the text where a secret stood.
BLACKED_OUT = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learnable("doc_id"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates.without_near_duplicates(docs)


def black_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = secrets.redacted_documents(docs, BLACKED_OUT)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", black_out_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, hashes and random rounding can't be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
