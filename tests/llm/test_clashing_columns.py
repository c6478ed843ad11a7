"""Extra columns with names that the operators use inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlake.llm import anisotropic_ann, license_scan, line_dedup, mixing, ngram_join, sentencepiece, suffix_dedup, tiff, token_counts, toxicity

EXTRA = ["id", "key", "score", "positive", "n", "h", "g", "c", "f", "gone", "band", "bands", "places", "n_tokens", "n_bytes", "mix_tokens", "weight", "epochs", "component", "class_id", "held_out", "__row", "__lines", "__gone", "__score", "__text", "__hot", "row", "lines", "text_col", "licenses", "h1", "line", "near", "spans", "behind"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, f"line a {i % 3}\nline b\nline c\nwords of document number {i % 4} go here and on", "s%d" % (i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in EXTRA])


def test_results_do_not_depend_on_extra_columns(spark, wide):
    plain = wide.select("doc_id", "text", "source")
    labels = spark.createDataFrame([(0, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    operators = [
        token_counts.count_tokens, ngram_join.with_ids, suffix_dedup.digest, line_dedup.digest, tiff.text_media, license_scan.digest,
        lambda d: sentencepiece.digest(sentencepiece.encode(d)), lambda d: toxicity.toxicity(d, labels), lambda d: mixing.mix(d).select("doc_id", "mix_epoch", "mix_block", "mix_tokens"),
    ]
    for op in operators:
        assert sorted(map(str, op(wide).collect())) == sorted(map(str, op(plain).collect()))


def test_filters_keep_every_column(spark, wide):
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")
    for out in (toxicity.reject_toxic(wide, labels), line_dedup.drop_repeats(wide), ngram_join.keep_one(wide)):
        assert out.columns == wide.columns
        out.collect()


def test_vectors_beside_extra_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(150)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wide = plain.select("*", *[F.lit(None).cast("string").alias(c) for c in ("id", "v", "b", "qb", "is_query", "ids", "vs", "codes", "salt", "score", "rank", "query_id")])
    assert sorted(map(str, anisotropic_ann.nearest(wide).collect())) == sorted(map(str, anisotropic_ann.nearest(plain).collect()))
