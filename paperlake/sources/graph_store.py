"""A stored graph that batches are merged into without rewriting it.

Rows lie in hash buckets. A commit adds one part (Parquet files) to each bucket
that it touches; a bucket that would have more than ``most_parts`` parts is
merged into one, and no other is rewritten. Which parts of which buckets make up
a version stands in a table of one file for each version. It is written last,
so readers see whole versions, and a commit that fails leaves the last one as it was.

Rows carry the number of their commit (``seq``), and reading merges a node's or
edge's rows by it, last writer first, as a batch job would. Moves of placeholders to real
papers are rows of the store, too: reading applies them.

Each writer numbers its commits; one that was committed before is left out, so a
batch that a stream runs again changes nothing. Writers take turns: of two that
commit the same version the second fails. Files of replaced parts and old versions
stay until the cluster clears them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.graph import EDGE, NODE, apply_moves
from paperlake.sources.io import EDGES, NODES
from paperlake.sources.shared import distrust_file_sizes

ROWS = {"nodes": f"{NODES}, seq long", "edges": f"{EDGES}, seq long", "moves": "stub_id string, real_id string, seq long"}
KEYS = {"nodes": ["node_id"], "edges": ["source_id", "target_id"], "moves": ["stub_id"]}
#: One row for each part of each bucket, one for each writer's last commit, one for the number of buckets.
VERSION = "kind string, bucket int, part string, seq long, version long"


@dataclass
class GraphStore:
    spark: SparkSession
    path: str
    buckets: int = 64
    most_parts: int = 4

    def __post_init__(self) -> None:
        """Opens the store, or makes an empty one with ``buckets`` buckets."""
        distrust_file_sizes(self.spark)
        try:
            self.version()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            self._publish(0, [("store", self.buckets, "", 0)])
        self.buckets = next(r["bucket"] for r in self._parts() if r["kind"] == "store")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions")

    def version(self) -> int:
        return self._versions().agg(F.max("version")).first()[0]

    def _parts(self, version: int | None = None) -> list:
        """The rows of a version: buckets times ``most_parts`` at most, whatever the graph's size."""
        return self._versions().where(F.col("version") == (self.version() if version is None else version)).collect()

    def _publish(self, version: int, parts: list) -> None:
        rows = self.spark.createDataFrame(parts, "kind string, bucket int, part string, seq long")
        rows.coalesce(1).write.parquet(f"{self.path}/versions/version={version}")

    def bucket(self, kind: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[kind]), F.lit(self.buckets)).cast("int")

    def rows(self, kind: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows of ``kind`` as they were written, of some buckets or all."""
        live = [r for r in self._parts(version) if r["kind"] == kind and (buckets is None or r["bucket"] in buckets)]
        return self._read(kind, [(r["part"], r["bucket"]) for r in live])

    def _read(self, kind: str, parts: list[tuple[str, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ROWS[kind])
        base = f"{self.path}/{kind}"
        return self.spark.read.schema(ROWS[kind]).option("basePath", base).parquet(*[f"{base}/part={p}/bucket={b}" for p, b in parts]).drop("part", "bucket")

    @staticmethod
    def merge(kind: str, rows: DataFrame) -> DataFrame:
        """One row per node, edge or placeholder, with the number of the last commit that wrote it.

        Each field and property by its last writer. A node's or edge's rows, one for each part that has it, come
        together in one shuffle with all of their properties; a commit should have each node and edge once.
        """
        if kind == "moves":
            return rows.groupBy("stub_id").agg(F.max_by("real_id", "seq").alias("real_id"), F.max("seq").alias("seq"))
        keys = ["node_id"] if kind == "nodes" else ["source_id", "edge_type", "target_id"]
        fields = [c for c in (NODE if kind == "nodes" else EDGE) if c not in (*keys, "properties")]
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields]
        entries = F.transform(F.map_entries("properties"), lambda e: F.struct(e.key.alias("k"), F.col("seq"), e.value.alias("v")))
        got = rows.withColumn("p", entries).groupBy(*keys).agg(*last, F.array_sort(F.flatten(F.collect_list("p"))).alias("p"), F.max("seq").alias("seq"))
        newest = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1).k != x.k, F.lit(True)))
        return got.withColumn("properties", F.map_from_entries(F.transform(newest, lambda x: F.struct(x.k, x.v)))).drop("p")

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a version (the last one), with placeholders moved."""
        v = self.version() if version is None else version
        nodes, edges, moves = (self.merge(kind, self.rows(kind, v)) for kind in ("nodes", "edges", "moves"))
        if not any(r["kind"] == "moves" for r in self._parts(v)):
            return nodes.select(*NODE), edges.select(*EDGE)
        return apply_moves(nodes.select(*NODE), edges.select(*EDGE), moves.select("stub_id", "real_id"))

    def known_ends(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Edges both of whose ends are among ``nodes`` or stored; of the store only the buckets of the other ends are read."""
        ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
        new = nodes.select("node_id").distinct()
        other = ends.join(new, "node_id", "left_anti")
        touched = {r["b"] for r in other.select(self.bucket("nodes").alias("b")).distinct().collect()}
        if not touched:
            return edges
        known = new.unionByName(self.rows("nodes", buckets=touched).select("node_id").join(other, "node_id", "left_semi").distinct())
        for side in ("source_id", "target_id"):
            edges = edges.join(known.select(F.col("node_id").alias(side)), side, "left_semi")
        return edges

    def commit(self, number: int, nodes: DataFrame | None = None, edges: DataFrame | None = None, moves: DataFrame | None = None, writer: str = "batch") -> bool:
        """Adds nodes, edges and moves as commit ``number`` of ``writer``; false if that one is there already.

        An edge needs both ends, among the new nodes or the stored ones.
        """
        version = self.version()
        parts = [(r["kind"], r["bucket"], r["part"], r["seq"]) for r in self._parts(version)]
        last = max((p[3] for p in parts if p[0] == "writer" and p[2] == writer), default=None)
        if last is not None and number <= last:
            return False
        name = f"{version + 1}-{uuid.uuid4().hex[:12]}"
        none = self.spark.createDataFrame([], ROWS["nodes"])
        if edges is not None:
            edges = self.known_ends(none if nodes is None else nodes, edges)
        for kind, new in (("nodes", nodes), ("edges", edges), ("moves", moves)):
            if new is None:
                continue
            columns = [c.split()[0] for c in ROWS[kind].split(", ")]
            self._write(kind, new.withColumn("seq", F.lit(version + 1).cast("long")).select(*columns), name)
            touched = self._buckets_of(kind, name)
            parts += [(kind, b, name, version + 1) for b in touched]
            full = [b for b in touched if sum(p[0] == kind and p[1] == b for p in parts) > self.most_parts]
            if full:
                gone = {(kind, p[1], p[2]) for p in parts if p[0] == kind and p[1] in full}
                self._write(kind, self.merge(kind, self._read(kind, [(p, b) for _, b, p in gone])).select(*columns), f"{name}-merged")
                parts = [p for p in parts if p[:3] not in gone] + [(kind, b, f"{name}-merged", version + 1) for b in full]
        parts = [p for p in parts if not (p[0] == "writer" and p[2] == writer)] + [("writer", 0, writer, number)]
        self._publish(version + 1, parts)
        return True

    def _write(self, kind: str, rows: DataFrame, part: str) -> None:
        """A bucket of many rows is split over tasks, each of which writes a file of it."""
        rows.withColumn("bucket", self.bucket(kind)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{kind}/part={part}")

    def _buckets_of(self, kind: str, part: str) -> list[int]:
        try:
            written = self.spark.read.schema(f"{ROWS[kind]}, bucket int").parquet(f"{self.path}/{kind}/part={part}")
        except AnalysisException as e:  # a part without rows has no files
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        return sorted(r["bucket"] for r in written.select("bucket").distinct().collect())
