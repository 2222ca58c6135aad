"""The corpus pipeline: quality rules, near-duplicate removal, personal data, source mixing, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``: quality rules drop
the documents that they reject, near-duplicate removal keeps one document of each group, personal data is replaced by its kind
in angle brackets, and mixing repeats or cuts documents to the budgets of their sources. Packing gives the place of each piece.

Defined cases: a null or empty text is rejected by the first stage, as is any of fewer than twenty words; null ids, languages and sources go
through as values of their own; repeated rows are near duplicates of each other, so that one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retort.llm import mixing, near_dedup, packing, pii, quality
from retort.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without personal data."""
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, a row for each time that a document is taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the mixture goes."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the packing, which places each piece by those placed before it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
