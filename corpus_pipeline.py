"""A corpus from raw documents to token ids: five stages over the operators of ``strandline.llm``, each written as
Parquet and read again before the next. Each stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, common, jaccard, mixing, quality, queries, secrets


def with_size(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their host repeats above its limit."""
    return with_size(quality.clean(docs, "doc_id", "source", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, "doc_id", "text")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return with_size(secrets.redact(docs, "text"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled."""
    return mixing.mix(docs, "doc_id", "source", "text", queries.WEIGHTS, other=0.66, size=1.5).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in the order of the shuffle: doc_id, n_tokens, ids."""
    return bpe.encode(docs, "doc_id", "text", queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_weights", mixing_weights),
    ("byte_bpe", byte_bpe),
]

# Sketches, spans of entropy and merges by rank have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
