"""The corpus pipeline: from raw documents to packed training sequences.

Every stage works on all that its predecessor kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgauge.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from sparkgauge.llm.common import materialize
from sparkgauge.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or near no language that the labelled ones teach."""
    return language_id.in_some_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the smallest doc_id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the smallest doc_id."""
    return ngram_join.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences: a row per piece."""
    return packing.pack_documents(docs, tokenizer()).drop("row_uid")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("best-fit packing", pack)]

#: Learned profiles, signatures, edit distances and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
