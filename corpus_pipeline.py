"""The training-data pipeline: toxicity, line dedup, near duplicates, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's documents. A table without rows passes every
stage. Columns besides id, text and source are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import line_dedup, mixing, ngram_join, sentencepiece, toxicity
from paperlake.llm.common import materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored from the bias alone, repeated rows alike; without any label every row stays.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no line is left.

    Null and empty texts stay as they are; rows with equal id and text count as one, so none is the other's later copy.
    """
    return line_dedup.drop_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, of equal rows one; null, empty and blank texts are in no group and stay."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the copies that the source weights call for; a null source is a source like others."""
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document; a null or empty text has none. Of language and source, those columns that there are stay."""
    return sentencepiece.encode(docs, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: A trained classifier can't be written in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
