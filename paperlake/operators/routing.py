"""Confidence of extractions, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT, SHORT, SHORT_PENALTY, AGREEMENT = 0.90, 40, 0.20, 0.15
AUTO, DRAFT = 0.85, 0.50
KEYS = {"entity": ["name", "type"], "relation": ["source", "relation", "target"]}
ROUTES = ["auto_insert", "draft", "manual", "discarded"]


def score(confidence: Column, evidence: Column, agreed: Column) -> Column:
    base = F.coalesce(confidence.try_cast("double"), F.lit(DEFAULT))
    n = F.length(F.trim(F.coalesce(evidence, F.lit(""))))
    total = base - F.when(n < SHORT, SHORT_PENALTY).otherwise(0.0) + F.when(F.coalesce(agreed, F.lit(False)), AGREEMENT).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def decide(c: Column, auto: float = AUTO, draft: float = DRAFT) -> Column:
    if draft > auto:
        raise ValueError("the draft threshold is above the automatic one")
    return F.when(c >= auto, "auto_insert").when(c >= draft, "draft").when(c > 0, "manual").otherwise("discarded")


def merge_sources(heuristic: DataFrame, llm: DataFrame, kind: str) -> DataFrame:
    """Full outer union on the key; the llm row wins where both have one, and ``agreed`` is set."""
    names = KEYS[kind]
    low = [(F.lower(n) if n not in ("type", "relation") else F.col(n)).alias(f"k_{n}") for n in names]
    keys = ["paper_id", *[f"k_{n}" for n in names]]
    fields = [c for c in heuristic.columns if c in llm.columns and c != "paper_id"]
    h = heuristic.select("paper_id", *low, F.struct(*fields).alias("r"), "pos").groupBy(*keys).agg(F.min_by("r", "pos").alias("h"))
    m = llm.select("paper_id", *low, F.struct(*fields).alias("r"), "pos").groupBy(*keys).agg(F.max_by("r", "pos").alias("m"))
    d = h.join(m, keys, "full_outer")
    r = F.coalesce("m", "h")
    by = F.when(F.col("m").isNull(), "heuristic").when(F.col("h").isNull(), "llm").otherwise("both")
    return d.select("paper_id", *[r[f].alias(f) for f in fields if f != "extracted_by"], by.alias("extracted_by"), (F.col("m").isNotNull() & F.col("h").isNotNull()).alias("agreed"))


def route(df: DataFrame, auto: float = AUTO, draft: float = DRAFT) -> DataFrame:
    """Adds the final confidence (4 places) and the routing, decided before rounding."""
    given = F.col("confidence") if "confidence" in df.columns else F.lit(None).cast("double")
    agreed = F.col("agreed") if "agreed" in df.columns else F.lit(False)
    d = df.withColumn("confidence", score(given, F.col("evidence"), agreed))
    return d.withColumn("routing", decide(F.col("confidence"), auto, draft)).withColumn("confidence", F.round("confidence", 4))


def split_routed(df: DataFrame, has_queue: bool = True) -> tuple[DataFrame, DataFrame]:
    """What goes to the graph, and what to the queue. Without a queue all but the discarded goes to the graph."""
    if has_queue:
        return df.where("routing = 'auto_insert'"), df.where("routing in ('draft', 'manual')")
    return df.where("routing <> 'discarded'"), df.where("false")


def routing_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("paper_id", "kind").agg(*[F.count_if(F.col("routing") == r).alias(r) for r in ROUTES])
