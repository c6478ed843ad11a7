"""Content addresses, job rows and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_address(docs: DataFrame, col: str = "text", order: str = "doc_id") -> DataFrame:
    """One row per content: ``address`` (SHA-256 hex), the smallest source key, and how many copies."""
    return docs.groupBy(F.sha2(F.coalesce(col, F.lit("")), 256).alias("address")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def skip_known(docs: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    return docs if force else docs.join(known.select("address").distinct(), "address", "left_anti")


def upsert_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per (doc_id, task_id): the last status, and of each other field the last value supplied."""
    keys = ["doc_id", "task_id"]
    both = jobs.withColumn("seq", F.lit(0).cast("long")).unionByName(updates.withColumn("seq", F.col("seq").cast("long")))
    rest = [c for c in jobs.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest])


def run_status(steps: DataFrame) -> DataFrame:
    """FAILED if reading or parsing had an error, PARTIAL for any other error, else COMPLETED."""
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    d = steps.groupBy("paper_id").agg(F.bool_or(bad & F.upper("step_name").isin("OCR", "PARSING")).alias("f"), F.bool_or(bad).alias("p"))
    return d.select("paper_id", F.when(F.col("f"), "FAILED").when(F.col("p"), "PARTIAL").otherwise("COMPLETED").alias("status"))


def run_report(steps: DataFrame, counts: DataFrame) -> DataFrame:
    """Status, counts by kind (map) and steps in order, per paper. ``counts``: paper_id, kind, n."""
    s = steps.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "step_name", "status", "error", "duration_ms"))).alias("steps"))
    c = counts.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    return run_status(steps).join(s, "paper_id").join(c, "paper_id", "left")
