"""A training-data pipeline: five operators over ``documents``, each stage stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commentlake.llm import exact_dedup, packing, quality_rules, secret_scan, simhash
from commentlake.session import work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link within three bits, directly or in steps, the one with the smallest id."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that are not copied examples masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.packed(packing.pieces(docs)).drop("ids")


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near),
    ("secret scan", secrets), ("best-fit packing", pack),
]
#: SQL can say neither fingerprints by bit nor tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
