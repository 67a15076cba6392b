"""Nearest-neighbour graphs by descent: neighbours of neighbours are looked at until hardly any list changes.

The first lists come from trees: random planes through the middle of the vectors cut them into leaves, in which all
pairs are compared; one more tree of random leaves gives every vector someone. Then, in rounds, each vertex brings
together some of its neighbours and of those that have it as theirs, of which at least one of a pair must be new to the
vertex, and each of a pair that is nearer to the other than its farthest neighbour is offered to it. A round is three
joins; no task holds more than the vertices of its part with their few neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import checked, pairwise
from nearfield.functions.hashing import hyperplanes
from nearfield.operators.knn import as_given, matrix, prepared
from nearfield.shared import Scratch, materialize

#: Trees, vectors of a leaf, neighbours of each kind that a vertex brings together, changed part of all lists at which it ends.
TREES, LEAF, SAMPLE, ENOUGH, MOST_ROUNDS = 4, 128, 8, 0.002, 16
#: Vertices of a task's group.
GROUP = 2048
_NEAR = "src long, dst long, dist double"


def _parts(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(max(1, n // GROUP))).cast("int"))


def _table(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(dist, pa.float64())})


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))).tolist() if len(x) else [0]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _leaves(vectors: DataFrame, metric: str, n: int, trees: int, leaf: int, s: Scratch) -> DataFrame:
    """(tree, leaf, key, v): every vector once for each tree; leaves over ``leaf`` vectors are split by a hash."""
    depth = min(31, max(1, math.ceil(math.log2(max(2, n / leaf)))))
    middle = None
    if metric != "hamming":
        rows = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).orderBy("at").collect()
        middle = np.array([r["m"] for r in rows])

    def run(batches):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), metric)
            if metric == "hamming":
                pick = np.random.default_rng(7).integers(0, 32 * x.shape[1], (trees, depth))
                bits = (x[:, pick // 32] >> (pick % 32)) & 1
            else:
                planes = hyperplanes(trees * depth, x.shape[1]) if planes is None else planes
                bits = ((x - middle) @ planes.T >= 0).astype(np.int64).reshape(len(x), trees, depth)
            code = (bits << np.arange(depth)).sum(2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t]), *b.columns], names=["tree", "leaf", "key", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    split = vectors.mapInArrow(run, f"tree int, leaf long, key long, v {kind}")
    chance = vectors.select(F.lit(trees).alias("tree"), F.pmod(F.xxhash64("key", F.lit(5)), F.lit(max(1, 4 * n // leaf))).alias("leaf"), "key", "v")
    rows = split.unionByName(chance)  # made twice, which costs less than writing every vector once a tree
    size = s.write(rows.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).cast("int").alias("cells")).where("cells > 1"), "sizes")
    cell = F.pmod(F.xxhash64("key", F.lit(11)), F.coalesce("cells", F.lit(1)))
    return rows.join(size, ["tree", "leaf"], "left").select(F.xxhash64("tree", "leaf", cell).alias("leaf"), "key", "v")


def _first_lists(leaves: DataFrame, metric: str, k: int, n: int, compared) -> DataFrame:
    """The k nearest of each vector in each of its leaves."""

    def run(group):
        group = group.sort_by("leaf").combine_chunks()
        keys, m = group["key"].to_numpy(), matrix(group["v"].chunk(0), metric)
        out = []
        for a, b in _runs(group["leaf"].to_numpy()):
            size = b - a
            if size < 2:
                continue
            compared.add(size * (size - 1) // 2)
            i, j = (x.ravel() for x in np.meshgrid(np.arange(a, b), np.arange(a, b), indexing="ij"))
            i, j = i[i != j], j[i != j]
            d = np.concatenate([pairwise(metric, m[i[x : x + 65536]], m[j[x : x + 65536]]) for x in range(0, len(i), 65536)])
            order = np.lexsort((keys[j], d, i)).reshape(size, size - 1)[:, :k].ravel()
            out.append((keys[i[order]], keys[j[order]], d[order]))
        return _table(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else _table(*[np.zeros(0)] * 3)

    return _parts(leaves, 4 * n, "leaf").groupBy("part").applyInArrow(run, _NEAR)


def _offers(members: DataFrame, metric: str, k: int, compared) -> DataFrame:
    """Members (part, u, key, fresh, far, v) to pairs that improve a list: (src, dst, dist), the k best of a src in a part."""

    def run(group):
        group = group.sort_by("u").combine_chunks()
        u, keys, fresh, far = (group[c].to_numpy(zero_copy_only=False) for c in ("u", "key", "fresh", "far"))
        m, out = matrix(group["v"].chunk(0), metric), []
        for a, b in _runs(u):
            i, j = np.triu_indices(b - a, 1)
            some = fresh[a + i] | fresh[a + j]
            i, j = a + i[some], a + j[some]
            if len(i):
                compared.add(len(i))
                d = pairwise(metric, m[i], m[j])
                for x, y in ((i, j), (j, i)):
                    ok = d < far[x]
                    out.append((keys[x[ok]], keys[y[ok]], d[ok]))
        if not out:
            return _table(*[np.zeros(0)] * 3)
        src, dst, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((dst, dist, src))
        src, dst, dist = src[order], dst[order], dist[order]
        new = np.ones(len(src), bool)
        new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]) | (dist[1:] != dist[:-1])  # one pair has one distance
        src, dst, dist = src[new], dst[new], dist[new]
        nth = np.arange(len(src)) - np.searchsorted(src, src)
        return _table(src[nth < k], dst[nth < k], dist[nth < k])

    return members.groupBy("part").applyInArrow(run, _NEAR)


def _lists(rows: DataFrame, k: int, sample: int) -> DataFrame:
    """The k nearest of rows (src, dst, dist, fresh, was) for each src; ``use`` marks the new ones that come together next."""
    one = rows.repartition("src").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("was").alias("was"), F.max(F.when(F.col("was"), F.col("fresh"))).alias("old"))
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("r") <= k)
    one = one.select("src", "dst", "dist", F.coalesce("old", F.lit(True)).alias("fresh"), (~F.col("was")).alias("changed"), F.count(F.lit(1)).over(Window.partitionBy("src")).alias("n"), F.max("dist").over(Window.partitionBy("src")).alias("last"))
    nth = F.row_number().over(Window.partitionBy("src", "fresh").orderBy("dist", "dst"))
    return one.select("src", "dst", "dist", "fresh", "changed", F.when(F.col("n") == k, F.col("last")).otherwise(float("inf")).alias("far"), (nth <= sample).alias("use"))


def descend(vectors: DataFrame, k: int, metric: str = "l2", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, enough: float = ENOUGH, most: int = MOST_ROUNDS) -> tuple[DataFrame, dict]:
    """((src, dst, dist), about): k neighbours of every vector, most of them its nearest, never itself.

    ``about`` has the rounds, the lists' changes in each, and how many pairs were compared (tasks that ran twice count
    twice). Vectors must have ids of their own; rows that ``prepared`` leaves out take no part. The same input gives the same graph.
    """
    checked(metric)
    compared = vectors.sparkSession.sparkContext.accumulator(0)
    with Scratch(vectors.sparkSession, "descent") as s:
        rows = s.write(as_given(prepared(vectors, metric, "vec_id", vector), vectors, vector), "vectors")
        n, changes = rows.count(), []
        first = _first_lists(_leaves(rows, metric, n, trees, leaf, s), metric, k, n, compared)
        near = s.next(_lists(first.withColumns({"fresh": F.lit(True), "was": F.lit(False)}), k, sample), "near")
        for r in range(most):
            both = near.where("use").select(F.col("src").alias("u"), F.col("dst").alias("key"), "fresh")
            back = near.where("use").select(F.col("dst").alias("u"), F.col("src").alias("key"), "fresh")
            turn = F.row_number().over(Window.partitionBy("u", "fresh").orderBy(F.xxhash64("u", "key", F.lit(r))))
            back = back.withColumn("turn", turn).where(F.col("turn") <= sample).drop("turn")
            members = both.unionByName(back).groupBy("u", "key").agg(F.max("fresh").alias("fresh"))
            # Where nobody is new, nobody is brought together.
            some = F.max("fresh").over(Window.partitionBy("u"))
            members = s.next(members.withColumn("some", some).where("some").drop("some"), "members")
            far = near.groupBy("src").agg(F.max("far").alias("far")).withColumnRenamed("src", "key")
            own = rows.join(far, "key", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
            offers = _offers(_parts(members.join(own, "key"), n, "u"), metric, k, compared)
            kept = near.select("src", "dst", "dist", (F.col("fresh") & ~F.col("use")).alias("fresh"), F.lit(True).alias("was"))
            near = s.next(_lists(kept.unionByName(offers.withColumns({"fresh": F.lit(True), "was": F.lit(False)})), k, sample), "near")
            changes.append(near.where("changed").count())
            if changes[-1] <= enough * n * k:
                break
        return materialize(near.select("src", "dst", "dist"), "descent"), {"vectors": n, "rounds": len(changes), "changes": changes, "compared": compared.value}
