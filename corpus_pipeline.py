"""A corpus, from documents to packed training sequences: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import hostrules, mixing, neardup, packing, pii
from loomlog.llm.shared import passing_tables, written  # noqa: F401


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or a soft rule on a bad host, go."""
    return hostrules.without_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8) stays."""
    return neardup.without_near_duplicates(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return mixing.mixed_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence; sequences follow the order of the mix."""
    return packing.pack_in_order(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packed)]

#: Tokens and packing can't be written in SQL; tests/llm/test_pipeline.py holds all stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next. When the fourth is
    written, the tables before it are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with passing_tables() as last:
        for name, stage in STAGES[:-2]:
            with passing_tables() as keep:
                docs = keep(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-2]
        docs = last(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
