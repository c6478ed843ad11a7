"""The review queue: drafts, votes, resolutions, reputation, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.graph import curated_graph, merge_edges, merge_nodes
from paperlake.sources.shared import written

THRESHOLD = 2
STATUSES = ["pending", "promoted", "rejected"]


def queue_drafts(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draft and manual rows, pending; and an audit row with the count per paper."""
    d = routed.where("routing in ('draft', 'manual')").withColumn("status", F.lit("pending"))
    audit = d.groupBy("paper_id").agg(F.count("*").alias("n")).select("paper_id", F.lit("drafts_queued").alias("action"), F.to_json(F.struct(F.col("n").alias("count"))).alias("detail"))
    return d, audit


def list_drafts(drafts: DataFrame, filters: dict[str, str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    for k, v in (filters or {}).items():
        if v is not None:
            drafts = drafts.where(F.col(k) == v)
    return drafts.orderBy("confidence", "created_at", "id").offset(max(0, offset)).limit(max(1, min(200, limit)))


def queue_stats(drafts: DataFrame, paper_id: str | None = None) -> DataFrame:
    d = drafts if paper_id is None else drafts.where(F.col("paper_id") == paper_id)
    return d.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def valid_votes(votes: DataFrame) -> DataFrame:
    return votes.where("vote in (1, -1)")


def current_votes(votes: DataFrame) -> DataFrame:
    """One per (draft, user): the latest."""
    return valid_votes(votes).groupBy("draft_id", "user_id").agg(F.max_by("vote", F.struct("ts", "id")).alias("vote"))


def attestation_scores(drafts: DataFrame, votes: DataFrame) -> DataFrame:
    s = current_votes(votes).groupBy("draft_id").agg(F.sum("vote").alias("s"))
    return drafts.select(F.col("id").alias("draft_id")).join(s, "draft_id", "left").select("draft_id", F.coalesce("s", F.lit(0)).alias("score"))


def vote_deltas(votes: DataFrame) -> DataFrame:
    """Votes with what each changes: a second vote of a user moves the score by the difference."""
    own = Window.partitionBy("draft_id", "user_id").orderBy("ts", "id")
    return valid_votes(votes).withColumn("delta", F.col("vote") - F.coalesce(F.lag("vote").over(own), F.lit(0)))


def vote_slices(votes: DataFrame) -> DataFrame:
    """``draft_id, slice, user_id, ts, id, delta, prefix``: votes in slices of time order, with the sum so far in the slice.

    Slices are range partitions of (draft, time, id), so a draft with a third
    of all votes has many. They are written down: their bounds are drawn once.
    """
    n = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = vote_deltas(votes).select("draft_id", "user_id", "ts", "id", "delta")
    d = d.repartitionByRange(n, "draft_id", "ts", "id").withColumn("slice", F.spark_partition_id())
    upto = Window.partitionBy("draft_id", "slice").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return written(d.withColumn("prefix", F.sum("delta").over(upto)), "vote-slices")


def resolve_drafts(drafts: DataFrame, votes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``draft_id, status, score, resolved_by, resolved_at, resolved_vote``: decided by the first vote that reaches the threshold; later ones are ignored.

    A prefix scan in two phases: each slice of a draft's votes gives its sum and
    its least and greatest prefix, the sums are carried over the slices (no more
    rows per draft than there are partitions), and only the first slice in which
    the threshold is passed is opened.
    """
    slices = vote_slices(votes)
    sums = slices.groupBy("draft_id", "slice").agg(F.sum("delta").alias("total"), F.min("prefix").alias("low"), F.max("prefix").alias("high"))
    earlier = Window.partitionBy("draft_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    passes = (F.col("before") + F.col("high") >= threshold) | (F.col("before") + F.col("low") <= -threshold)
    per_draft = carried.groupBy("draft_id").agg(F.sum("total").alias("open_score"), F.min(F.when(passes, F.struct("slice", "before"))).alias("first"))
    first = per_draft.where("first is not null").select("draft_id", "first.*")
    opened = slices.join(first, ["draft_id", "slice"]).withColumn("score", F.col("before") + F.col("prefix")).where(F.abs("score") >= threshold)
    hit = opened.groupBy("draft_id").agg(F.min_by(F.struct("score", "user_id", "ts", "id"), F.struct("ts", "id")).alias("r"))
    d = drafts.select(F.col("id").alias("draft_id")).join(hit, "draft_id", "left").join(per_draft.select("draft_id", "open_score"), "draft_id", "left")
    status = F.when(F.col("r.score") >= threshold, "promoted").when(F.col("r.score") <= -threshold, "rejected").otherwise("pending")
    return d.select("draft_id", status.alias("status"), F.coalesce("r.score", "open_score", F.lit(0)).alias("score"), F.col("r.user_id").alias("resolved_by"), F.col("r.ts").alias("resolved_at"), F.col("r.id").alias("resolved_vote"))


def award_reputation(resolved: DataFrame, votes: DataFrame) -> DataFrame:
    """One point to each user whose vote at the resolution was the winning one."""
    r = resolved.where("status <> 'pending'").select("draft_id", "resolved_at", "resolved_vote", F.when(F.col("status") == "promoted", 1).otherwise(-1).alias("won"))
    d = valid_votes(votes).join(r, "draft_id").where("ts < resolved_at or (ts = resolved_at and id <= resolved_vote)")
    at = d.groupBy("draft_id", "user_id", "won").agg(F.max_by("vote", F.struct("ts", "id")).alias("vote"))
    return at.where("vote = won").groupBy("user_id").agg(F.count("*").alias("reputation"))


def leaderboard(reputation: DataFrame, limit: int = 10) -> DataFrame:
    return reputation.where("reputation > 0").orderBy(F.desc("reputation"), "user_id").limit(max(1, min(100, limit)))


def manual_resolution(drafts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts after promote / reject actions (``draft_id, action, user_id, ts, id``), and errors.

    The first action on a pending draft decides; the same action again changes
    nothing; the other one is an error, as is an unknown draft.
    """
    state = F.when(F.col("action") == "promote", "promoted").otherwise("rejected")
    a = actions.where("action in ('promote', 'reject')").withColumn("wanted", state)
    d = drafts.select("id", "status").withColumnRenamed("id", "draft_id")
    j = a.join(d, "draft_id", "left")
    first = j.where("status = 'pending'").groupBy("draft_id").agg(F.min_by(F.struct("wanted", "user_id", "ts", "id"), F.struct("ts", "id")).alias("f"))
    out = drafts.join(first.withColumnRenamed("draft_id", "id"), "id", "left").select(
        *[F.coalesce("f.wanted", "status").alias("status") if c == "status" else F.col(c) for c in drafts.columns], F.col("f.user_id").alias("resolved_by"), F.col("f.ts").alias("resolved_at")
    )
    final = j.join(first, "draft_id", "left").withColumn("final", F.coalesce("f.wanted", "status"))
    errors = final.where("final is null or final <> wanted").select("draft_id", "action", "user_id", "ts", F.when(F.col("final").isNull(), "unknown draft").otherwise(F.concat(F.lit("already "), F.col("final"))).alias("error"))
    return out, errors


def audit_log(resolved: DataFrame) -> DataFrame:
    """One row per resolution, with JSON detail; ones by votes are never marked as written to the graph."""
    detail = F.to_json(F.struct("draft_id", "score", F.lit(False).alias("graph_written")))
    return resolved.where("status <> 'pending'").select("draft_id", F.concat(F.lit("draft_"), F.col("status")).alias("action"), F.col("resolved_by").alias("user_id"), F.col("resolved_at").alias("created_at"), detail.alias("detail"))


def pending_graph_writes(drafts: DataFrame, audit: DataFrame, paper_id: str | None = None) -> DataFrame:
    """Promoted drafts without an audit row that says they were written."""
    written = audit.where(F.get_json_object("detail", "$.graph_written") == "true").select(F.col("draft_id").alias("id")).distinct()
    d = drafts.where("status = 'promoted'")
    return (d if paper_id is None else d.where(F.col("paper_id") == paper_id)).join(written, "id", "left_anti")


PAYLOAD = "name string, type string, role string, evidence string, confidence double, source string, source_type string, relation string, target string, target_type string, source_section string"


def promoted_payloads(drafts: DataFrame) -> DataFrame:
    """Promoted drafts with the fields of their JSON payload, as ``graph.curated_graph`` takes them."""
    d = drafts.where("status = 'promoted'")
    by = F.col("resolved_by").cast("string") if "resolved_by" in drafts.columns else F.lit(None).cast("string")
    return d.select("id", "paper_id", "kind", by.alias("resolved_by"), F.from_json("payload", PAYLOAD).alias("p")).select("id", "paper_id", "kind", "resolved_by", "p.*")


def promote_to_graph(nodes: DataFrame, edges: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with the payloads of promoted drafts merged into it, and the rejected drafts."""
    new_nodes, new_edges, rejected = curated_graph(promoted_payloads(drafts))
    late = lambda d: d.withColumn("seq", F.lit(1).cast("long"))
    merged = written(merge_nodes(nodes, late(new_nodes)), "nodes")
    return merged, merge_edges(edges, late(new_edges), merged), rejected


def draft_with_votes(drafts: DataFrame, votes: DataFrame) -> DataFrame:
    v = current_votes(votes).groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("user_id", "vote"))).alias("votes"))
    return drafts.join(v.withColumnRenamed("draft_id", "id"), "id", "left").withColumn("votes", F.coalesce("votes", F.array().cast("array<struct<user_id:bigint,vote:int>>")))
