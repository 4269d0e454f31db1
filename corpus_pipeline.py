"""Clean and pack the documents: toxicity, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketgrid.llm.common import stage
from marketgrid.llm.decontaminate import drop_contaminated
from marketgrid.llm.packing import pack_documents
from marketgrid.llm.pii import redact
from marketgrid.llm.resemblance import keep_one
from marketgrid.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.

    Null and empty texts get the score of a text without terms; repeated rows go or stay together; an empty table gives
    no rows; further columns are kept.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles stays.

    It is the one with the smallest id (null ids last, then text and row hash, so repeated rows leave one). Null texts
    and texts without words are one group; an empty table gives no rows; further columns are kept.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay, null and empty items match nothing; repeated rows go or stay together; empty tables
    take nothing away; further columns are kept.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    Null and empty texts stay as they are, as do repeated rows; an empty table gives no rows; further columns are kept.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and their place in it.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows; the columns
    are those of a piece.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Toxicity model, fingerprints and token ids can't be written in SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
