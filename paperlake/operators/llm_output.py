"""Model responses, which arrive as a table of raw text per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators.ontology import valid_edges

FIELDS = ["name", "type", "evidence", "confidence", "source_section", "source", "relation", "target"]
EXTRACTABLE = ["Method", "Dataset", "Task", "Metric", "Claim", "Experiment"]


def parse_json_array(raw: Column) -> Column:
    """Items (variants) of the whole text, of a fenced block, or of the outermost brackets; one object counts as a list of one; else empty."""
    fence = X.capture(raw, r"(?s)```(?:json)?\s*(.*?)```")
    outer = X.capture(raw, r"(?s)(\[.*\])")
    none = F.array().cast("array<variant>")

    def read(c: Column) -> Column:
        v = F.try_parse_json(F.trim(c))
        kind = F.schema_of_variant(v)
        return F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none)).when(kind.startswith("OBJECT"), F.array(v))

    return F.coalesce(read(raw), read(fence), read(outer), none)


def _text(item: Column, field: str) -> Column:
    """A field's text with white space as single spaces; empty if it is absent or no string."""
    v = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", X.collapse(F.try_variant_get(v, "$", "string"))).otherwise("")


def _confidence(item: Column) -> Column:
    """Between 0 and 1; 0.5 if it is no number."""
    c = F.try_variant_get(item, "$.confidence", "string").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.5))))


def _items(responses: DataFrame, texts: DataFrame) -> DataFrame:
    d = responses.select("paper_id", F.posexplode(parse_json_array(F.col("raw"))).alias("pos", "i"))
    d = d.where(F.schema_of_variant("i").startswith("OBJECT"))
    d = d.select("paper_id", "pos", *[_text(F.col("i"), f).alias(f) for f in FIELDS if f != "confidence"], _confidence(F.col("i")).alias("confidence"))
    return d.join(texts.select("paper_id", "text"), "paper_id").where(X.evidence_grounded(F.col("evidence"), F.col("text"))).drop("text")


def validate_llm_entities(responses: DataFrame, texts: DataFrame, extracted_by: str = "llm") -> DataFrame:
    """Items with a name, a known type and evidence that stands in the text; ``extracted_by`` names the model's version."""
    d = _items(responses, texts).where(F.col("type").isin(EXTRACTABLE) & (F.col("name") != ""))
    return d.select("paper_id", "pos", "name", "type", "source_section", "evidence", "confidence", F.lit(extracted_by).alias("extracted_by"))


def validate_llm_relations(responses: DataFrame, texts: DataFrame, entities: DataFrame, extracted_by: str = "llm") -> DataFrame:
    """Both ends must be entities of the paper (types are taken from there, the last of a name wins), and keep the relation's own spelling; no self relation."""
    known = entities.groupBy("paper_id", F.lower("name").alias("low")).agg(F.max_by("type", "pos").alias("kind"))
    end = lambda side: known.select("paper_id", F.col("low").alias(f"{side}_low"), F.col("kind").alias(f"{side}_type"))
    d = _items(responses, texts).withColumns({"source_low": F.lower("source"), "target_low": F.lower("target")})
    d = d.where("source_low <> target_low").join(end("source"), ["paper_id", "source_low"]).join(end("target"), ["paper_id", "target_low"])
    d = d.select("paper_id", "pos", "source", "source_type", F.col("relation").alias("edge_type"), "target", "target_type", "evidence", "confidence", F.lit(extracted_by).alias("extracted_by"))
    return valid_edges(d).withColumnRenamed("edge_type", "relation")


def last_relations(relations: DataFrame) -> DataFrame:
    """The last of equal (source, relation, target)."""
    w = Window.partitionBy("paper_id", F.lower("source"), "relation", F.lower("target")).orderBy(F.desc("pos"))
    return relations.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
