"""Embedding, exact vector search and vector tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.sources.shared import written

DIM = 384
METRICS = ("cosine", "euclid", "dot")
#: Queries that one task holds at a time.
QUERY_BLOCK = 1_024
#: Chunks that one task compares with them at a time, on average.
CHUNK_BLOCK = 4_096
#: Queries for each of which a round ships all chunks once.
LANE = 65_536
#: Pivots at most, chunks for each of them (on average) below that number, and shells around each.
PIVOTS, PIVOT_ROWS, SHELLS = 2_048, 4_096, 4
#: Shells that a query visits first, more if those hold fewer than k chunks.
FIRST = 2


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """SHA-256 bytes over 255, repeated to ``dim``."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0).cast("float"))


def embed(df: DataFrame, text_col: str = "text", backend: str | Callable[[Iterator[pd.Series]], Iterator[pd.Series]] = "hash", dim: int = DIM, out: str = "embedding") -> DataFrame:
    """Adds vectors by the built-in hash backend, or by a batch embedder (iterator of series in, of lists out)."""
    if backend == "hash":
        return df.withColumn(out, hash_embedding(F.col(text_col), dim))
    fn: Callable = backend  # type: ignore[assignment]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from fn(texts)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """One minus the distance: cosine; one minus squared distance; one plus the inner product. The cosine of a zero vector is null."""
    if metric == "cosine":
        return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "euclid":
        gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return 1.0 - F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return 1.0 + _dot(a, b)
    raise ValueError(metric)


def apply_filters(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """All of them: equal to a value, or one of a list."""
    for k, v in (filters or {}).items():
        df = df.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def vector_search(chunks: DataFrame, vector: list[float], k: int = 5, filters: dict[str, object] | None = None, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best of one query; filters apply before scoring; a score that is no number takes no rank."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = apply_filters(chunks, filters).withColumn("score", similarity(F.col(vector_col), q, metric))
    return d.where("score is not null and not isnan(score)").orderBy(F.desc("score"), id_col).limit(k)


def _rows(vectors, metric: str) -> np.ndarray:
    """One row a vector, in double precision; of length one for cosine."""
    v = np.stack(list(vectors)).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * v @ pivots.T, 0))


def _finite(v: np.ndarray) -> np.ndarray:
    return np.isfinite((v**2).sum(1))


def score_bounds(v: np.ndarray, pivots: np.ndarray, groups: pd.DataFrame, metric: str) -> np.ndarray:
    """No member of a group scores higher than this: queries by groups (``pivot``, least and greatest distance ``lo`` and ``hi`` from it).

    By the triangle inequality a member is at least ``d - hi`` and ``lo - d`` from a query
    at distance ``d`` from the pivot; its inner product is that of the pivot and the
    query's norm times ``hi`` at most. The slack covers rounding: a distance by
    matrix products may be off by the root of the precision. Groups of pivot -1
    (vectors that are no number or overflow) and such queries have no bound.
    """
    at, lo, hi = groups["pivot"].to_numpy(), groups.lo.to_numpy()[None], groups.hi.to_numpy()[None]
    norm = np.linalg.norm(v, axis=1)[:, None]
    size = norm + np.linalg.norm(pivots, axis=1)[at][None] + hi
    slack = 2e-6 * size
    if metric == "dot":
        top = 1 + (v @ pivots.T)[:, at] + norm * (hi + slack)
    else:
        d = _distances(v, pivots)[:, at]
        gap = np.maximum(np.maximum(d - hi, lo - d) - slack, 0)
        top = 1 - gap**2 / (2 if metric == "cosine" else 1)
    top = top + 1e-12 * (1 + size**2)
    return np.where(np.isnan(top) | (at < 0)[None] | ~_finite(v)[:, None], np.inf, top)


def _slices(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), n):
            yield b.iloc[i : i + n]


def _best(pairs: DataFrame, k: int, metric: str, kinds: tuple[str, str]) -> DataFrame:
    """``q, c, score``: the k best of each pair of a cell and a block of queries, but those below what the query has (``least``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                a, v = _rows((x["cv"] for x in r.chunks), metric), _rows((x["qv"] for x in r.queries), metric)
                s = v @ a.T
                if metric == "euclid":
                    s = 1 - ((v**2).sum(1)[:, None] + (a**2).sum(1)[None] - 2 * s)
                elif metric == "dot":
                    s = 1 + s
                ids = np.array([x["c"] for x in r.chunks])
                order = np.argsort(ids, kind="stable")
                top = np.argsort(np.where(np.isnan(s), np.inf, -s)[:, order], axis=1, kind="stable")[:, :k]
                names = [x["q"] for x in r.queries]
                best = pd.DataFrame({"q": np.repeat(names, top.shape[1]), "c": ids[order][top].ravel(), "score": np.take_along_axis(s[:, order], top, 1).ravel()})
                least = np.repeat(np.array([-np.inf if x["least"] is None else x["least"] for x in r.queries], float), top.shape[1])
                yield best[best.score.notna() & ~(best.score < least - 1e-9 * (1 + np.abs(least)))]

    return pairs.mapInPandas(run, f"q {kinds[0]}, c {kinds[1]}, score double")


def batch_vector_search(queries: DataFrame, chunks: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_col: str = "query_embedding") -> DataFrame:
    """``query_id, id, score, rank``: exact top k of every query, without a look at chunks that can't reach it.

    Chunks belong to their nearest pivot (``PIVOTS`` at most, those of least hash) and a
    shell of distance from it; a shell is dealt over cells of about ``CHUNK_BLOCK``.
    A query first visits the few shells of highest bound (``score_bounds``), then all those
    whose bound reaches its k-th score. Queries meet cells through an equi-join, in blocks of
    ``QUERY_BLOCK``; a round ships a chunk once for each ``LANE`` of queries, and a
    query to the cells it visits. Only pivots and shells (``PIVOTS * (SHELLS + 1)`` rows)
    pass the driver. Pairs without a score (the cosine of a zero vector, components that
    are no number) take no rank.
    """
    spark = chunks.sparkSession
    kinds = dict(queries.dtypes)[query_id], dict(chunks.dtypes)[id_col]
    scored = lambda c: (F.exists(c, lambda x: x != 0) if metric == "cosine" else F.col(c).isNotNull())
    exact = lambda df, c: F.col(c) if dict(df.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>")
    c = chunks.where(scored(vector_col)).select(F.col(id_col).alias("c"), exact(chunks, vector_col).alias("cv"))
    q = queries.where(scored(query_col)).select(F.col(query_id).alias("q"), exact(queries, query_col).alias("qv"))
    n = max(1, -(-q.count() // QUERY_BLOCK))
    lanes = max(1, -(-n * QUERY_BLOCK // LANE))

    most = max(1, min(PIVOTS, -(-c.count() // PIVOT_ROWS)))
    whole = F.forall("cv", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100))
    found = c.where(whole).orderBy(F.xxhash64("c"), "c").limit(most).select("cv").collect()
    pivots = _rows((r.cv for r in found), metric) if found else None
    width = (float(_distances(pivots[:1], pivots).max()) if found else 0.0) / SHELLS or 1.0

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, 1024):
            v = _rows(b.cv, metric)
            ok = _finite(v) if pivots is not None else np.zeros(len(v), bool)
            pivot, dist = np.full(len(v), -1), np.zeros(len(v))
            if ok.any():
                d = _distances(v[ok], pivots)
                pivot[ok], dist[ok] = d.argmin(1), d.min(1)
            shell = np.minimum(dist / width, SHELLS - 1).astype(int)
            yield pd.DataFrame({"c": b.c, "cv": b.cv, "pivot": pivot, "shell": shell, "dist": dist})

    placed = c.mapInPandas(nearest, f"c {kinds[1]}, cv {dict(c.dtypes)['cv']}, pivot int, shell int, dist double")
    placed = written(placed, "placed")
    stats = placed.groupBy("pivot", "shell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    kind = {"pivot": int, "shell": int, "n": int, "lo": float, "hi": float}
    groups = pd.DataFrame([tuple(r) for r in stats.orderBy("pivot", "shell").collect()], columns=list(kind)).astype(kind)
    groups["cells"] = -(-groups.n // CHUNK_BLOCK)
    groups["first"] = groups.cells.cumsum() - groups.cells
    places = spark.createDataFrame([(int(r.pivot), int(r.shell), int(r.cells), int(r.first)) for r in groups.itertuples()], "pivot int, shell int, cells long, first long")
    cell = (F.col("first") + F.pmod(F.xxhash64("c"), F.col("cells"))).alias("cell")
    packed = placed.join(F.broadcast(places), ["pivot", "shell"]).select(cell, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "c", "cv")
    packed = packed.groupBy("cell", "lane").agg(F.collect_list(F.struct("c", "cv")).alias("chunks"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups of the first round, or those of the second: of the rest, whose bound reaches the k-th score."""
        held, none = groups.n.to_numpy(), np.zeros((1, 1))
        for b in _slices(batches, 128):
            v = _rows(b.qv, metric)
            top = score_bounds(v, none.repeat(v.shape[1], 1) if pivots is None else pivots, groups, metric)
            if "least" in b:
                go = top >= b.least.fillna(-np.inf).to_numpy()[:, None]
                for i, seen in enumerate(b.visited):
                    go[i, np.asarray(seen, int)] = False
            else:
                order = np.argsort(-top, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                go = np.zeros(top.shape, bool)
                np.put_along_axis(go, order, (before < k) | (np.arange(len(held)) < FIRST), axis=1)
            to = [np.flatnonzero(x) for x in go]
            cells = [np.concatenate([np.arange(f, f + m) for f, m in zip(groups["first"].to_numpy()[g], groups.cells.to_numpy()[g], strict=True)] or [np.zeros(0, int)]) for g in to]
            yield pd.DataFrame({"q": b.q, "qv": b.qv, "least": b.get("least"), "visited": to, "cells": cells})

    def meet(asked: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("q"), F.lit(n))
        x = asked.select("q", "qv", "least", block.alias("block"), F.pmod(block, F.lit(lanes)).cast("int").alias("lane"), F.explode("cells").alias("cell"))
        x = x.groupBy("cell", "lane", "block").agg(F.collect_list(F.struct("q", "qv", "least")).alias("queries"))
        return _best(packed.join(x, ["cell", "lane"]).select("chunks", "queries"), k, metric, kinds)

    form = f"q {kinds[0]}, qv {dict(q.dtypes)['qv']}, least double, visited array<int>, cells array<long>"
    first = written(q.mapInPandas(visits, form), "visits")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = lambda df: df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    near = written(best(meet(first)), "near")
    least = near.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    second = first.drop("least").join(least, "q", "left").select("q", "qv", "visited", "least").mapInPandas(visits, form)
    out = best(near.drop("rank").unionByName(meet(second)))
    return out.select(F.col("q").alias(query_id), F.col("c").alias(id_col), "score", "rank")


def graph_filtered_search(chunks: DataFrame, allowed: DataFrame, vector: list[float], k: int = 5, **more) -> DataFrame:
    """Only chunks of allowed papers; no allowed paper means no restriction."""
    if allowed.isEmpty():
        return vector_search(chunks, vector, k, **more)
    return vector_search(chunks.join(allowed.select("paper_id").distinct(), "paper_id", "left_semi"), vector, k, **more)


def paper_search(chunks: DataFrame, vector: list[float], k: int = 5, **more) -> DataFrame:
    """Papers of the best 3k chunks: best score, chunks, sections, text of the best; the best k."""
    hits = vector_search(chunks, vector, 3 * k, **more)
    d = hits.groupBy("paper_id").agg(
        F.max("score").alias("score"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("section")).alias("sections"), F.max_by("text", F.struct("score", "id")).alias("text")
    )
    return d.orderBy(F.desc("score"), "paper_id").limit(k)


def collection_stats(chunks: DataFrame, vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Points, smallest and largest dimension, and whether the table must be rebuilt for ``dim``."""
    size = F.size(vector_col)
    d = chunks.where(F.col(vector_col).isNotNull()).agg(F.count("*").alias("n_points"), F.min(size).alias("least_dim"), F.max(size).alias("dim"))
    want = F.col("dim") if dim is None else F.lit(dim)
    return d.withColumn("rebuild", F.coalesce((F.col("least_dim") != F.col("dim")) | (F.col("dim") != want), F.lit(False)))


def replace_paper_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A paper that is sent again loses all its old points."""
    return existing.join(new.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(new)
