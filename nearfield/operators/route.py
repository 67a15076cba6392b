"""Shards of near vectors, so that a query goes to a few of them.

Centroids are fitted on a bounded sample. Every vector goes to its nearest centroid; a centroid with more vectors than a
shard may hold has several shards, dealt out by a hash. A query visits all shards of its nearest centroids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import between, checked
from nearfield.operators.knn import matrix, prepared, ranked
from nearfield.operators.search import Graph, Options

#: Sampled vectors for each centroid, bytes of the sample at most, rounds of fitting.
SAMPLE, SAMPLE_BYTES, ROUNDS = 64, 64 << 20, 8
#: Queries that meet a shard in one task, give or take a hash's unevenness, and tasks for each core if there are fewer shards.
TURN, TASKS = 1 << 18, 2


@dataclass
class Routes:
    """Centroids, and the first shard and the number of shards of each."""

    metric: str
    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def nearest(self, m: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest centroids of each row, nearest first; by the metric itself, so ties go to the lower number."""
        if not len(m):
            return np.zeros((0, min(n, len(self.centroids))), np.int64)
        about, _ = between(self.metric, m, self.centroids)
        return np.argsort(about, axis=1, kind="stable")[:, :n]


def _fit(rows: np.ndarray, n: int, metric: str) -> np.ndarray:
    """Lloyd's rounds; a centroid that nobody is nearest to takes the row farthest from its own."""
    c = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].astype(np.float64)
    for _ in range(ROUNDS):
        d, _ = between("l2", rows, c)
        near = d.argmin(1)
        far = np.argsort(-d[np.arange(len(rows)), near], kind="stable")
        for j, k in enumerate(np.flatnonzero(np.bincount(near, minlength=len(c)) == 0).tolist()):
            near[far[j]] = k
        total = np.zeros_like(c)
        np.add.at(total, near, rows)
        c = total / np.bincount(near, minlength=len(c))[:, None]
    return c


def _own(vectors: DataFrame, routes: Routes) -> DataFrame:
    """(vec_id, embedding, centroid)."""
    shared = vectors.sparkSession.sparkContext.broadcast(routes)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                near = shared.value.nearest(matrix(part.column(1), routes.metric), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], names=["vec_id", "embedding", "centroid"])

    rows = prepared(vectors, routes.metric, "vec_id", "embedding").select(F.col("key").alias("vec_id"), F.col("v").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, embedding array<double>, centroid int")


def deal(vectors: DataFrame, n: int, capacity: int, metric: str = "l2") -> tuple[DataFrame, Routes]:
    """(vec_id, embedding, shard) and the routes to ``n`` centroids' shards, none of which holds more than ``capacity`` vectors."""
    if checked(metric) == "hamming":
        raise ValueError("codes have no centroids")
    rows = prepared(vectors, metric, "vec_id", "embedding")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    most = max(n, min(SAMPLE * n, SAMPLE_BYTES // (8 * (size["w"] or 1))))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, size["n"] // most))) == 0).orderBy(F.xxhash64("key"), "key").limit(most).select("key", "v").toArrow().combine_chunks()
    routes = Routes(metric, _fit(matrix(sample["v"].chunk(0), metric), n, metric) if sample.num_rows else np.zeros((1, 1)), np.zeros(0, int), np.zeros(0, int))
    own = _own(vectors, routes)
    count = np.zeros(len(routes.centroids), np.int64)
    for r in own.groupBy("centroid").count().collect():  # a row for each centroid
        count[r["centroid"]] = r["count"]
    shards = np.maximum(1, -(-count // capacity))
    while True:  # a hash deals out unevenly: one more shard where one of them is over its size
        parts = F.array(*[F.lit(int(x)) for x in shards])[F.col("centroid")]
        dealt = own.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
        over = [r["centroid"] for r in dealt.groupBy("centroid", "part").count().where(F.col("count") > capacity).select("centroid").distinct().collect()]
        if not over:
            break
        shards[over] += 1
    routes.count, routes.first = shards, np.cumsum(shards) - shards
    first = F.array(*[F.lit(int(x)) for x in routes.first])[F.col("centroid")]
    return dealt.select("vec_id", "embedding", (first + F.col("part")).cast("int").alias("shard")), routes


def search_routed(queries: DataFrame, vectors: DataFrame, edges: DataFrame, routes: Routes, options: Options, visit: int = 3, k: int | None = None, query_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, dist): the best of the shards of each query's ``visit`` nearest centroids."""
    return ranked(found_routed(queries, vectors, edges, routes, options, visit, k, query_key, vector), k or options.pq)


def found_routed(queries: DataFrame, vectors: DataFrame, edges: DataFrame, routes: Routes, options: Options, visit: int = 3, k: int | None = None, query_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, dist, nth): the ``k`` best of each shard of the query's ``visit`` nearest centroids, of which it is the nth.

    So a search of fewer centroids is the rows up to their number. Queries are dealt out to shards like vectors and edges,
    so a shard's task has its own queries only; many queries, or those of few shards, meet a shard in turns.
    """
    metric, k = options.metric, k or options.pq
    shared = queries.sparkSession.sparkContext.broadcast(routes)

    def sent(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part, r = b.slice(at, 4096), shared.value
                near = r.nearest(matrix(part.column(1), metric), visit)
                n = r.count[near]
                row = np.repeat(np.arange(len(near)), n.sum(1))
                flat, of = n.ravel(), np.repeat(r.first[near].ravel(), n.ravel())
                shard = of + np.arange(len(of)) - np.repeat(np.cumsum(flat) - flat, flat)
                nth = np.repeat(np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(near)), n.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(nth), *(c.take(pa.array(row)) for c in part.columns)], names=["shard", "nth", "query_id", "q"])

    asked = prepared(queries, metric, query_key, vector)
    turns = max(-(-TASKS * queries.sparkSession.sparkContext.defaultParallelism // max(1, int(routes.count.sum()))), -(-asked.count() // TURN), 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    asked = asked.mapInArrow(sent, "shard int, nth int, query_id long, q array<double>").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    right = edges.select("shard", every, "src", "rank", "dst", none("long").alias("query_id"), none("array<double>").alias("q"), none("int").alias("nth"))
    right = right.unionByName(asked.select("shard", "turn", none("long").alias("src"), none("int").alias("rank"), none("long").alias("dst"), "query_id", "q", "nth"))
    own = vectors.select("shard", every, "vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def run(left, right):
        left, right = left.combine_chunks(), right.combine_chunks()
        ask = right.filter(pa.compute.is_valid(right["query_id"])).combine_chunks()
        near = right.filter(pa.compute.is_null(right["query_id"]))
        if not left.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "nth": pa.array([], pa.int32())})
        graph = Graph.of(left["vec_id"].to_numpy(), matrix(left["v"].chunk(0), metric), *(near[c].to_numpy() for c in ("src", "rank", "dst")))
        found = [(i[:k], d[:k]) for i, d, _ in graph.search_all(matrix(ask["q"].chunk(0), metric), options)]
        ids, dist = (np.concatenate(x) for x in zip(*found, strict=True))
        size = [len(i) for i, _ in found]
        return pa.table({"query_id": np.repeat(ask["query_id"].to_numpy(), size), "vec_id": ids.astype(np.int64), "dist": dist, "nth": np.repeat(ask["nth"].to_numpy(), size)})

    return own.groupBy("shard", "turn").cogroup(right.groupBy("shard", "turn")).applyInArrow(run, "query_id long, vec_id long, dist double, nth int")
