"""Bounded breadth-first walks over citations, for many seeds at once.

Each round is written down, so that plans don't multiply with the hops; edges
lie in buckets, so that rounds don't shuffle them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.sources.shared import shared_dir, written

#: Neighbours of a node that one slice holds, and salts by which hubs are looked up.
HUB, SALTS = 100_000, 32
WALK = "seed string, node string, paper_id string, title string, depth int, path array<string>, direction string"


def _neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """``node, next, way``: 0 forward, 1 backward; equal citations aren't brought together yet."""
    c = edges.where("edge_type = 'CITES' and source_id <> target_id")
    forward = F.struct(F.col("source_id").alias("node"), F.col("target_id").alias("next"), F.lit(0).alias("way"))
    backward = F.struct(F.col("target_id").alias("node"), F.col("source_id").alias("next"), F.lit(1).alias("way"))
    ways = {"forward": [forward], "backward": [backward], "both": [forward, backward]}[direction]
    return c.select(F.explode(F.array(*ways)).alias("h")).select("h.*")


class Adjacency:
    """Neighbours written once, in buckets by ``node`` and, where there are hubs, ``slice``, so that a hop shuffles the frontier only.

    A node of over ``HUB`` neighbours is dealt over slices of about that many; its
    frontier rows are repeated for each. Hubs are few (one for each ``HUB`` edges) but
    not broadcast: both sides meet them by node and one of ``SALTS`` salts. ``edges`` are
    read twice, for the hubs and for the table.
    """

    def __init__(self, edges: DataFrame, direction: str):
        spark = edges.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hops = _neighbours(edges, direction)
        hubs = hops.groupBy("node").agg(F.ceil(F.count("*") / HUB).cast("int").alias("slices")).where("slices > 1")
        self.hubs = written(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "hubs")
        self.keys = ["node"] if self.hubs.isEmpty() else ["node", "slice"]
        if "slice" in self.keys:
            dealt = hops.withColumn("salt", _salt("next")).join(self.hubs, ["node", "salt"], "left")
            hops = dealt.select("node", F.coalesce(F.pmod(F.xxhash64("next"), F.col("slices")), F.lit(0)).cast("int").alias("slice"), "next", "way")
        name = f"paperlake_hops_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/paperlake/{name}"
        hops.repartition(n, *self.keys).distinct().write.bucketBy(n, *self.keys).option("path", path).saveAsTable(name)
        self.hops = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # only its name in the catalogue: the files are external

    def step(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` (``seed, node`` and more) with ``next, way`` of each hop."""
        if "slice" not in self.keys:
            return frontier.join(self.hops, "node")
        d = frontier.withColumn("salt", _salt("seed")).join(self.hubs, ["node", "salt"], "left")
        d = d.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("salt", "slices")
        return d.join(self.hops, ["node", "slice"]).drop("slice")


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")


def citation_neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    """Distinct ``seed, node`` within 1 to ``depth`` (clamped to 1..5) hops, without the seed itself; seeds are node ids."""
    hops = Adjacency(edges, direction)
    seen = frontier = seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node")).distinct()
    for _ in range(max(1, min(5, depth))):
        found = hops.step(frontier).select("seed", F.col("next").alias("node")).distinct()
        frontier = written(found.join(seen, ["seed", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("seed <> node")


def expand_citations(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "both", max_depth: int = 2, max_papers: int = 50, hops: Adjacency | None = None) -> DataFrame:
    """``seed, node, paper_id, title, depth, path, direction``: each paper once, at its shallowest place, at most ``max_papers`` a seed.

    A node's parents are taken in the order they were found, forward before
    backward, then by node id. Ranks are per seed and hop, so the cap cuts the
    frontier each round. ``hops`` is the table of ``edges`` in ``direction``, where several walks share it;
    without any seed none is made.
    """
    start = written(seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node")).distinct(), "seeds")
    if start.isEmpty():
        return edges.sparkSession.createDataFrame([], WALK)
    hops = hops or Adjacency(edges, direction)
    frontier = start.select("seed", "node", F.array("node").alias("path"), F.lit(0).cast("long").alias("rank"))
    seen, found = start, None
    counts = start.select("seed", F.lit(0).cast("long").alias("n"))
    for depth in range(1, max(1, min(5, max_depth)) + 1):
        # a parent's rank tells its path, which is fetched for the nodes that are left
        step = hops.step(frontier.select("seed", "node", "rank")).select("seed", F.col("next").alias("node"), (F.col("rank") * 2 + F.col("way")).alias("at"))
        best = step.groupBy("seed", "node").agg(F.min("at").alias("at")).join(seen, ["seed", "node"], "left_anti")
        order = Window.partitionBy("seed").orderBy("at", "node")
        ranked = best.withColumn("nth", F.row_number().over(order).cast("long")).join(counts, "seed").where(F.col("n") + F.col("nth") <= max_papers)
        parents = frontier.select("seed", F.col("rank").alias("parent"), F.col("path").alias("to"))
        new = ranked.withColumn("parent", F.floor(F.col("at") / 2)).join(parents, ["seed", "parent"]).select(
            "seed", "node", F.concat("to", F.array("node")).alias("path"), F.col("nth").alias("rank"), F.lit(depth).alias("depth"),
            F.when(F.col("at") % 2 == 0, "forward").otherwise("backward").alias("direction"),
        )
        new = written(new, "walk")
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select("seed", "node"))
        counts = seen.groupBy("seed").agg((F.count("*") - 1).alias("n"))
        frontier = new.select("seed", "node", "path", "rank")
    titles = nodes.where("node_type = 'Paper'").select(F.col("node_id").alias("node"), "paper_id", F.col("name").alias("title"))
    return found.join(titles, "node").select("seed", "node", "paper_id", "title", "depth", "path", "direction")
