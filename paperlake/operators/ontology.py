"""The ontology as a table of 26 allowed (source, edge, target) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import vocab


def ontology(spark: SparkSession) -> DataFrame:
    rows = [(s, e, t) for s, e, targets in vocab.ONTOLOGY for t in targets]
    return spark.createDataFrame(rows, "source_type string, edge_type string, target_type string")


def valid_edges(df: DataFrame) -> DataFrame:
    """Rows whose (source_type, edge_type, target_type) is allowed; the broadcast side has 26 rows."""
    return df.join(F.broadcast(ontology(df.sparkSession)), ["source_type", "edge_type", "target_type"], "left_semi")


def allowed_targets(spark: SparkSession) -> DataFrame:
    return ontology(spark).groupBy("source_type", "edge_type").agg(F.array_sort(F.collect_set("target_type")).alias("targets"))


def describe_ontology(spark: SparkSession) -> DataFrame:
    return allowed_targets(spark).select(F.concat_ws(" ", "source_type", "edge_type", F.array_join("targets", "|")).alias("rule"))
