"""A corpus pipeline: language, near copies, repeated passages, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All
but the last return the columns of ``documents``; the results in between are Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, jaccard, langid, mixing, suffix
from graphloom.llm.common import durable, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognizable language."""
    prepare(spark)
    return langid.accepted(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    prepare(spark)
    return jaccard.first_of_each(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat, of over 50 words (150 bytes at least) or of 400 bytes or more; documents stay."""
    prepare(spark)
    return suffix.clean(docs, width=150, words=50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the rows in the mixture's order; none is dropped."""
    prepare(spark)
    return mixing.interleave(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    prepare(spark)
    return bpe.token_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: The stages are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
