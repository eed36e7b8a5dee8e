"""Corpus pipeline: five of the operators in a row, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylospark.llm import bpe, common, exact_dedup, mixing, near_dedup, quality
from stylospark.session import ship


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go. Null texts are judged as
    empty ones, repeated rows alike; without labels of both classes, or without rows,
    it does as quality.keep_good says."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts one row stays, the longest, then that of the smallest
    doc_id; null texts equal empty ones, and of rows repeated whole any one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates one document stays, that of the
    smallest doc_id (null first); texts without a word are one group."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows are repeated, three times at most, or left out so that sources
    near their targets; a null source is one, null texts have no words."""
    return mixing.mix(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token ids of each row; a null text has none. Empty tables pass through
    all stages as empty ones."""
    import public_tokenizers

    ids = bpe.encode(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", "source", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: The classifier, the signatures and the draws have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
