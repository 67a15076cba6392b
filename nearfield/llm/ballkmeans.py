"""Ball k-means over integer vectors: exact Lloyd rounds that compare a member only with the centroids it may move to.

A cluster is a ball: its centroid and a bound on the distance of its members from it. Another centroid is a neighbour of
the ball if it is at most twice that radius away; no member is nearer to any other. The neighbours in order of distance
cut the ball into a core, nearer to its own centroid than half the way to the first neighbour, which is stable, and
annuli: a member between half the way to the j-th and half the way to the next one is compared with the first j. All
comparisons are of integers, so the result is that of comparing with every centroid.

The vectors are narrow integers, written once a round with their cluster; a round sends the executors the centroids and
their neighbours and brings back one sum for each cluster and component.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, map_batches, materialize

#: Components are held at this value at most, so that squared distances of 64 components fit 64 bits.
MOST = 1 << 27
#: Up to this value all sums of 64 squares are exact in doubles, and products go by the fast routines.
EXACT_DOUBLES = 1 << 22
_STATE = "vec_id long, v array<int>, cluster int, distance long"


def integer_vectors(vectors: DataFrame, scale: int = 64, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of vectors of ``dim`` components, none null or non-finite; others go.

    Values beyond plus or minus MOST are held there: the squared distance of larger ones is no 64-bit integer.
    """
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(c * F.lit(float(scale))).cast("double")))
    return vectors.where(whole).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: held(c).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``seed:vec_id``; rows without an id come last, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b``, exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT_DOUBLES and a.shape[1] <= 64:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j in range(len(b)):
        d = a - b[j]
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass
class Balls:
    """Centroids, and for each cluster: neighbours nearest first, their squared distances, and whether nothing near it moved."""

    centroids: np.ndarray
    near: list[np.ndarray]
    far: list[np.ndarray]
    still: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray, widest: np.ndarray) -> Balls:
        """``widest``: the largest squared distance of a cluster's members to where its centroid was ``before``.

        A member is no farther from the new centroid than that way and the centroid's own; empty clusters (-1) have no ball.
        """
        k, step = len(centroids), max(1, (1 << 22) // len(centroids))
        moved = np.sqrt(np.array([squared(centroids[i : i + 1], before[i : i + 1])[0, 0] for i in range(k)], np.float64))
        # A little more, so that rounding of the roots leaves no neighbour out.
        reach = np.where(widest < 0, -1.0, (np.sqrt(np.maximum(widest, 0).astype(np.float64)) + moved) * (1 + 1e-9) + 1e-6)
        near, far = [], []
        for at in range(0, k, step):
            gap = squared(centroids[at : at + step], centroids)
            for i, row in enumerate(gap, at):
                j = np.flatnonzero((np.sqrt(row.astype(np.float64)) <= 2 * reach[i]) & (np.arange(k) != i))
                j = j[np.argsort(row[j], kind="stable")]
                near.append(j)
                far.append(row[j])
        quiet = moved == 0
        return cls(centroids, near, far, np.array([bool(quiet[i] and quiet[near[i]].all()) for i in range(k)]))

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New clusters and squared distances of members, which are compared with neighbours ring by ring."""
        to, best = cluster.copy(), distance.copy()
        order = np.argsort(cluster, kind="stable")
        ids, start = np.unique(cluster[order], return_index=True)
        for i, rows in zip(ids.tolist(), np.split(order, start[1:]), strict=True):
            if self.still[i]:
                continue
            own = squared(v[rows], self.centroids[i : i + 1])[:, 0]
            to[rows], best[rows] = i, own
            # Rows from the outside in: the j-th neighbour concerns a first part of them, ever shorter.
            rows = rows[np.argsort(-own, kind="stable")]
            own = best[rows].copy()
            for j, gap in zip(self.near[i].tolist(), self.far[i].tolist(), strict=True):
                n = int(np.searchsorted(-4 * own, -gap, "right"))  # 4 d^2 >= D^2: not nearer than half the way
                if not n:
                    break
                d, part = squared(v[rows[:n]], self.centroids[j : j + 1])[:, 0], rows[:n]
                take = (d < best[part]) | ((d == best[part]) & (j < to[part]))
                best[part[take]], to[part[take]] = d[take], j
        return to, best


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _rows(b: pa.RecordBatch, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])


def _first_assignment(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def make():
        def run(b):
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                d = squared(_vectors(part.column(1)), shared.value)
                to = d.argmin(1)  # the first of equal ones
                yield _rows(part, to, d[np.arange(len(to)), to])

        return run

    return map_batches(vectors, make, _STATE)


def _next_assignment(state: DataFrame, balls: Balls) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(balls)

    def make():
        def run(b):
            yield _rows(b, *shared.value.assign(_vectors(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()))

        return run

    return map_batches(state, make, _STATE)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cluster: number of members, largest distance, and componentwise sums as Python integers.

    A task adds up its own rows; what is shuffled is k rows a task, what the driver gets k * dim numbers.
    """

    def run(batches):
        n, widest, total = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            if b.num_rows:
                cluster = b.column(1).to_numpy()
                n += np.bincount(cluster, minlength=k)
                np.maximum.at(widest, cluster, b.column(2).to_numpy())
                order = np.argsort(cluster, kind="stable")
                ids, start = np.unique(cluster[order], return_index=True)
                total[ids] += np.add.reduceat(_vectors(b.column(0))[order], start, axis=0)
        some = np.flatnonzero(n)
        if len(some):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(widest[some]), sums], names=["cluster", "n", "widest", "sums"])

    parts = state.select("v", "cluster", "distance").mapInArrow(run, "cluster int, n long, widest long, sums array<long>")
    each = parts.select("cluster", "n", "widest", F.posexplode("sums").alias("at", "part"))
    rows = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    n, widest, total = np.zeros(k, object), np.full(k, -1, np.int64), np.zeros((k, dim), object)
    for r in rows:
        n[r["cluster"]], widest[r["cluster"]], total[r["cluster"], r["at"]] = r["n"], r["widest"], int(r["total"])
    return n, widest, total


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """Assignments (vec_id, cluster, distance) of ``integer_vectors`` after ``rounds`` rounds and one more, and the centroids.

    Ties go to the smaller number; a new centroid is the exact floor of the mean; an empty cluster keeps its centroid;
    with fewer than ``k`` vectors there are as many clusters as vectors. Repeated rows are members each for itself. An
    empty table has no clusters. The driver compares the centroids with each other: k * k distances a round.
    """
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return materialize(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clusters"), centroids
    dim, old = centroids.shape[1], None
    scratch = Scratch(vectors.sparkSession, "kmeans")
    try:
        state = scratch.write(_first_assignment(vectors, centroids), "round")
        for _ in range(rounds):
            n, widest, total = _sums(state, k, dim)
            before, centroids = centroids, centroids.copy()
            for i in range(k):
                if n[i]:
                    centroids[i] = [int(t) // int(n[i]) for t in total[i]]
            if (centroids == before).all():  # and so are all later rounds
                break
            old, scratch = scratch, Scratch(vectors.sparkSession, "kmeans")
            state = scratch.write(_next_assignment(state, Balls.of(centroids, before, widest)), "round")
            old.drop()
        return materialize(state.drop("v"), "clusters"), centroids
    finally:
        scratch.drop()
        if old:
            old.drop()


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; see ``ball_kmeans``.

    Inertia is exact up to 64 bits and stays at the largest long beyond.
    """
    spark = vectors.sparkSession
    of, centroids = ball_kmeans(vectors, k, rounds, seed)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digest = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    held = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    own = of.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = F.sum("own").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # k rows
    totals = own.select("cluster", held(F.col("own")).alias("cluster_inertia"), held(every).alias("inertia"))
    about = totals.join(digest, "cluster")
    return of.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
