"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing, each on all that the stage before kept.

``run`` applies the stages to documents; each stage's rows are written as Parquet to the shared folder and read again as the next one's
``docs``. All stages but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.secrets import redact
from tidemark.llm.similar import keep_first
from tidemark.session import cut_lineage


def _few_rows_a_batch(spark: SparkSession) -> None:
    """Whole texts of any length pass Python: a thousand rows a batch keep a task's share of memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    _few_rows_a_batch(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more): that with the least doc_id."""
    _few_rows_a_batch(spark)
    return keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    _few_rows_a_batch(spark)
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words drawn from each source, a row per document and pass."""
    _few_rows_a_batch(spark)
    return mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    _few_rows_a_batch(spark)
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack_windows", pack_windows)]
#: Tokenising and hashing into a mix are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
