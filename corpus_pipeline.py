"""A corpus pipeline: language, near-duplicates, decontamination, personal data, mixture.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op01_pii, op02_mixing, op05_decontaminate, op07_near, op09_language
from tessera.llm.common import stash, table

#: Documents less alike than this to every language are rejected, as are those without letters.
LEAST_LANGUAGE_SCORE = 0.2
#: Words of a shingle, as the contract of the near-duplicate query has it.
SHINGLE_WORDS = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    return op09_language.keep_known(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as operator 7's query finds them (two-word shingles, similarity 0.8)."""
    return op07_near.keep_one(docs, SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return op05_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return op01_pii.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the copies that bring the corpus to its target weights; those without a copy go."""
    return op02_mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mixture", mixture)]

#: Profiles and classifiers can't be put in SQL; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
