"""From raw documents to packed training sequences: five stages, each over what the one before kept.

Every stage takes null in any column and empty, white and very long texts; repeated rows are
rows of their own until ``near_dedup`` leaves one; a null source is a source; columns beyond
those of ``documents`` pass through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark.llm import mixing, packing, pii, quality, simhash
from pollspark.llm.common import free
from pollspark.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and lie inside their language's perplexity band."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of fingerprints that differ in at most 3 bits; null ids come first."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, as the weights ask."""
    tokens = free("tokens", docs.columns)
    counted = docs.withColumn(tokens, mixing.token_count(F.col("text")))
    return mixing.mix(counted, "source", tokens, "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 ids."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix", mix_sources),
    ("pack", pack),
]
#: Fingerprints, language model and token ids are beyond SQL; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
