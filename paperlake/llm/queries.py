"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import anisotropic_ann, fill_in_middle, license_scan, line_dedup, mixing, ngram_join, sentencepiece, spelling, suffix_dedup, tiff, token_counts, toxicity, va_file
from paperlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.with_ids(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(sentencepiece.encode(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place", "mix_tokens")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.exact_top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_ngram_jaccard_join,
        op3_sentencepiece,
        op4_license_scan,
        op5_toxicity,
        op6_nearest_neighbours,
        op7_source_mixing,
        op8_tiff_media,
        op9_suffix_dedup,
        op10_line_dedup,
        op11_spelling_variants,
        op12_fill_in_middle,
        op13_exact_top_k,
    )
}

#: Equivalents in SQL, where there are any.
ORACLES: dict[str, str] = {
    "op11_spelling_variants": spelling.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_exact_top_k": va_file.SQL,
}
