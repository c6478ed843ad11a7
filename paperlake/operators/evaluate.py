"""Grading of retrieval modes on a question set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKS = ["retrieval_hit", "source_correct", "citation_correct", "grounded"]


def score_questions(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per question and mode. ``retrieved``: ``id, mode, facts, hits, source_paper_ids, context_text``.

    retrieval_hit: each expected name is, whatever its case, that of a fact's subject or
    object or of a hit's node;
    source_correct: any expected source was found, null if none is expected;
    citation_correct: a fact has the expected relation, null if none is expected;
    grounded: there is context and a source paper.
    """
    of_facts = F.flatten(F.transform("facts", lambda f: F.array(f.subject["name"], f.object["name"])))
    retrieved_names = F.transform(F.array_compact(F.concat(of_facts, F.transform("hits", lambda h: h.node_name))), F.lower)
    names = F.coalesce("expected_entities", F.array().cast("array<string>"))
    sources = F.coalesce("expected_sources", F.array().cast("array<string>"))
    d = questions.join(retrieved.withColumn("found", retrieved_names), "id")
    return d.select(
        "id", "category", "mode",
        (F.size(F.array_except(F.transform(names, F.lower), F.col("found"))) == 0).alias("retrieval_hit"),
        F.when(F.size(sources) > 0, F.arrays_overlap(sources, "source_paper_ids")).alias("source_correct"),
        F.when(F.nullif("expected_relation", F.lit("")).isNotNull(), F.exists("facts", lambda f: f.relation == F.col("expected_relation"))).alias("citation_correct"),
        ((F.length(F.trim(F.coalesce("context_text", F.lit("")))) > 0) & (F.size("source_paper_ids") > 0)).alias("grounded"),
    )


def summarize_eval(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates to 4 places per mode (and ``by``): nulls don't count, null where nothing could be checked."""
    return scores.groupBy("mode", *by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(f"{c}_rate") for c in CHECKS])
