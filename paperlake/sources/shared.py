"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where the setting is absent on one machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def distrust_file_sizes(spark: SparkSession) -> None:
    """No join is planned as a broadcast because its side's *file* is small: a few MB of compressed file can be millions of rows on the driver.

    What adaptive execution has measured to be below the session's threshold it still broadcasts. A session that sets the adaptive threshold itself is left alone.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(planned))
        spark.conf.set(planned, "-1")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a Parquet table: what reads it twice doesn't recompute it, and lineage ends there."""
    distrust_file_sizes(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/paperlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
