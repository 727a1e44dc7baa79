"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); every function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame. ``run`` writes each stage's result as Parquet to the shared folder and reads it back; the table
before is deleted then.

In every stage nulls in any column are allowed, null texts count as empty, texts of any length are read
whole, rows that repeat an id are rows of their own unless the stage drops copies, and extra columns are
kept whatever their names. No documents give no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathework.llm import decontaminate, langid, mixing, secret_scan, simhash
from lathework.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that are near enough to a language; ``lang`` becomes the language found.

    Ties go to the first language by name. Null and empty texts go.
    """
    return langid.keep_accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words, similarity 0.8; SimHash and MinHash candidates).

    Of rows that repeat that id one stays. Documents without an id all stay.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; repeated rows stay or go together."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; null texts stay null."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic meet the goals of the raking.

    Rows that repeat id and text are sampled together; null sources and languages are a value of their own.
    """
    return mixing.sample(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secrets), ("source_mixing", mixture)]

#: SQL can't express the classifier, the near copies' search or the raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", replaces=docs)
    return docs
