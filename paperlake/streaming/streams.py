"""Streaming forms of ingestion, identity resolution and voting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paperlake.operators.curation import THRESHOLD, valid_votes
from paperlake.operators.graph import identities
from paperlake.operators.vectors import replace_paper_vectors
from paperlake.plans.workloads import corpus_to_graph, extract, text_to_vectors
from paperlake.sources.graph_store import GraphStore
from paperlake.sources.io import PAGES

RESOLUTION = "draft_id long, status string, score int, resolved_by long, resolved_at timestamp, resolved_vote long"
IDENTITY = "key string, node_id string, paper_id string, is_stub boolean"
MOVE = "stub_id string, real_id string"


def _stateful(spark: SparkSession) -> None:
    """State with maps and timers needs the RocksDB provider; a session's own choice of it is left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, None) or ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, dim: int = 16, form: str = "parquet", buckets: int = 64) -> StreamingQuery:
    """New page files go through the whole ingestion per micro-batch; a paper that is sent again replaces its chunks.

    A batch's nodes and edges are committed to the stored graph in ``out_dir``,
    which leaves out a batch that is run again after a failure; its chunks and
    identities are written under its number and overwrite what a failed run left.
    ``resolve_stream`` turns identities into moves of placeholders.
    """
    pages = spark.readStream.schema(PAGES).format(form).load(in_dir)

    def batch(df: DataFrame, number: int) -> None:
        read = extract(df)
        nodes, edges = corpus_to_graph(df, resolve=False, extracted=read)
        GraphStore(spark, f"{out_dir}/graph", buckets).commit(number, nodes, edges, writer="ingest")
        identities(nodes).write.mode("overwrite").parquet(f"{out_dir}/identities/batch={number}")
        text_to_vectors(df, dim, extracted=read).write.mode("overwrite").parquet(f"{out_dir}/chunks/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Identity(StatefulProcessor):
    """State of one doi or arXiv id: the paper that has it, and its placeholder's node, whichever came first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.real = handle.getValueState("real", "paper_id string, node_id string")
        self.stub = handle.getValueState("stub", "node_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        had = tuple(self.real.get()) if self.real.exists() else None
        stub_before = stub = self.stub.get()[0] if self.stub.exists() else None
        real = had
        for pdf in rows:
            for node, paper, is_stub in zip(pdf.node_id, pdf.paper_id, pdf.is_stub, strict=True):
                if is_stub:
                    stub = node
                elif real is None or paper < real[0]:
                    real = (paper, node)
        if real != had:
            self.real.update(real)
        if stub != stub_before:
            self.stub.update((stub,))
        if real and stub and (real != had or stub_before is None):
            yield pd.DataFrame({"stub_id": [stub], "real_id": [real[1]]})

    def close(self) -> None:
        pass


def identity_moves(found: DataFrame) -> DataFrame:
    """``stub_id, real_id`` from a stream of ``key, node_id, paper_id, is_stub``: each arrival meets its earlier or later counterpart in the key's state.

    A stream to append to: each key passes through Python, which takes milliseconds. ``latest_moves`` gives the same moves without it.
    A key of which a paper with a smaller id turns up moves again. A key's state
    is one paper and one node, however often it is cited; a batch's rows of a key pass
    through one after the other.
    """
    _stateful(found.sparkSession)
    return found.groupBy("key").transformWithStateInPandas(_Identity(), MOVE, "append", "none")


def latest_moves(found: DataFrame) -> DataFrame:
    """The moves of ``identity_moves`` by a built-in aggregation, for a stream that updates.

    A key's state is its first paper and its placeholder, each with the time of the batch that brought it;
    a move is new if either came in this batch.
    """
    _stateful(found.sparkSession)
    now = F.current_timestamp()  # of the micro-batch, the same if it is run again
    d = found.withColumn("at", now)
    real = F.min(F.when(~F.col("is_stub"), F.struct("paper_id", "node_id", "at")))
    stub = F.when(F.col("is_stub"), F.col("node_id"))
    got = d.groupBy("key").agg(real.alias("real"), F.max(stub).alias("stub_id"), F.min(F.when(F.col("is_stub"), F.col("at"))).alias("stub_at"))
    return got.where((F.col("real.at") == now) | (F.col("stub_at") == now)).where("real is not null and stub_id is not null").select("stub_id", F.col("real.node_id").alias("real_id"))


def resolve_stream(spark: SparkSession, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Identities of ingested batches go through ``latest_moves``; moves are committed to the stored graph, whose old parts aren't read."""
    found = spark.readStream.schema(IDENTITY).parquet(f"{out_dir}/identities")

    def batch(df: DataFrame, number: int) -> None:
        GraphStore(spark, f"{out_dir}/graph").commit(number, moves=df, writer="moves")

    return latest_moves(found).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_graph(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the stored graph's last version, with the placeholders moved that ``resolve_stream`` has seen."""
    return GraphStore(spark, f"{out_dir}/graph").read()


def current_chunks(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """Chunks of the last batch that has each paper."""
    d = spark.read.schema(f"{schema}, batch long").parquet(f"{out_dir}/chunks")
    last = d.groupBy("paper_id").agg(F.max("batch").alias("batch"))
    return d.join(last, ["paper_id", "batch"], "left_semi")


class _Votes(StatefulProcessor):
    """State of a draft: score and status, and a map of its users' votes while it is open."""

    def __init__(self, threshold: int, forget_after_ms: int | None) -> None:
        self.threshold, self.forget_after_ms = threshold, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.draft = handle.getValueState("draft", "score int, status string")
        self.cast = handle.getMapState("cast", "user_id long", "vote int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.draft.exists()
        score, status = self.draft.get() if known else (0, "pending")
        if status != "pending":
            return
        new = pd.concat(list(rows)).sort_values(["ts", "id"])
        mine: dict[int, int] = {}
        for user, vote, ts, number in zip(new.user_id.tolist(), new.vote.tolist(), new.ts, new.id.tolist(), strict=True):
            if user not in mine:
                mine[user] = self.cast.getValue((user,))[0] if known and self.cast.containsKey((user,)) else 0
            score, mine[user] = score + vote - mine[user], vote
            if abs(score) >= self.threshold:
                status = "promoted" if score > 0 else "rejected"
                yield pd.DataFrame({"draft_id": [key[0]], "status": [status], "score": [score], "resolved_by": [user], "resolved_at": [ts], "resolved_vote": [number]})
                break
        self.draft.update((int(score), status))
        if status == "pending":
            for user, vote in mine.items():
                self.cast.updateValue((user,), (vote,))
            return
        if known:
            self.cast.clear()
        if self.forget_after_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_after_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.draft.clear()
        return iter([])

    def close(self) -> None:
        pass


def vote_stream(votes: DataFrame, threshold: int = THRESHOLD, forget_after_ms: int | None = None) -> DataFrame:
    """Resolutions of drafts, each once, from a stream of ``draft_id, user_id, vote, ts, id``.

    A batch reads and writes only the entries of its own users. After a
    resolution the draft's map goes and its status stays, so later votes are
    ignored; ``forget_after_ms`` drops the status, too, once that time has passed
    (give it only where no vote can come later than that).
    """
    _stateful(votes.sparkSession)
    grouped = valid_votes(votes).select("draft_id", F.col("user_id").cast("long").alias("user_id"), F.col("vote").cast("int").alias("vote"), "ts", F.col("id").cast("long").alias("id")).groupBy("draft_id")
    return grouped.transformWithStateInPandas(_Votes(threshold, forget_after_ms), RESOLUTION, "append", "none" if forget_after_ms is None else "processingTime")


__all__ = ["current_chunks", "current_graph", "identity_moves", "ingest_stream", "latest_moves", "replace_paper_vectors", "resolve_stream", "vote_stream"]
