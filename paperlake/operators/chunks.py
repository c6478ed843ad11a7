"""Text chunks for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X

SIZE, OVERLAP = 500, 50


def structured_chunks(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """Abstract, sections that aren't empty, then ``name: evidence`` of each entity; ``ord`` within the paper."""
    none = F.lit(None).cast("string")
    a = parsed.where(X.blank_to_null(F.col("abstract")).isNotNull()).select(
        "paper_id", F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("i")).alias("ord"), F.col("abstract").alias("text"), F.lit("Abstract").alias("section"),
        F.lit(None).cast("int").alias("page"), F.lit("Paper").alias("node_type"), F.col("title").alias("node_name"), none.alias("source_text"),
    )
    s = parsed.select("paper_id", F.explode("sections").alias("s")).where(X.blank_to_null(F.col("s.text")).isNotNull()).select(
        "paper_id", F.struct(F.lit(1).alias("k"), F.col("s.idx").cast("long").alias("i")).alias("ord"), F.col("s.text").alias("text"), F.col("s.heading").alias("section"),
        F.lit(None).cast("int").alias("page"), F.lit("Section").alias("node_type"), F.col("s.heading").alias("node_name"), none.alias("source_text"),
    )
    e = entities.select(
        "paper_id", F.struct(F.lit(2).alias("k"), F.col("pos").cast("long").alias("i")).alias("ord"), F.concat_ws(": ", "name", "evidence").alias("text"), F.col("source_section").alias("section"),
        F.lit(None).cast("int").alias("page"), F.col("type").alias("node_type"), F.col("name").alias("node_name"), F.col("evidence").alias("source_text"),
    )
    return a.unionByName(s).unionByName(e)


def word_window_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` words of each page, every ``size - overlap`` words (1 if that isn't positive)."""
    step = size - overlap if overlap < size else 1
    d = pages.select("paper_id", "page_num", F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    d = d.select("paper_id", "page_num", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("at"))
    none = F.lit(None).cast("string")
    return d.select(
        "paper_id", F.struct(F.col("page_num").cast("int").alias("k"), F.col("at").cast("long").alias("i")).alias("ord"),
        F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("text"), none.alias("section"), F.col("page_num").cast("int").alias("page"),
        none.alias("node_type"), none.alias("node_name"), none.alias("source_text"),
    )


def chunks_with_fallback(structured: DataFrame, windows: DataFrame) -> DataFrame:
    """Papers without any structured chunk use windows."""
    return structured.unionByName(windows.join(structured.select("paper_id").distinct(), "paper_id", "left_anti"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_index`` by order within the paper, ``chunk_id`` and its version 5 UUID ``id``."""
    d = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("paper_id").orderBy("ord")) - 1)
    d = d.withColumn("chunk_id", F.concat(F.col("paper_id"), F.lit("__chunk_"), F.format_string("%05d", "chunk_index")))
    return d.withColumn("id", X.uuid5(F.col("chunk_id"))).drop("ord")
