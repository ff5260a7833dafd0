"""From raw documents to packed training bins.

Each stage takes the documents its predecessor kept and, but for the last, returns documents
with all their columns: low quality goes, one of each group of near duplicates stays,
documents with benchmark passages go, secrets are masked, and the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.decontaminate import drop_contaminated
from tillroll.llm.packing import pack_documents
from tillroll.llm.quality import keep_good, learn_quality
from tillroll.llm.secret_scan import mask_secrets
from tillroll.llm.simhash import drop_near_duplicates
from tillroll.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, learned from ``labels``, does not reject."""
    return keep_good(docs, learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with its secrets masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document in one bin."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
ORACLE_SQL = None  # SQL cannot express the stages; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
