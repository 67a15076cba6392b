"""Proximity graphs: built vertex by vertex, or at once from exact neighbours; and their statistics.

An edge is (src, rank, dst, dist), rank from 1 by (dist, dst); a vertex has 2 * degree + 1 edges at most.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import checked, to_rows
from nearfield.operators.descent import descend
from nearfield.operators.knn import NEAR, knn, matrix, nearest_in_task, prepared
from nearfield.shared import Scratch, materialize

DEGREE, BUDGET = 15, 150


def insert_all(vectors: np.ndarray, metric: str = "l2", degree: int = DEGREE, budget: int = BUDGET) -> list[list[tuple[float, int]]]:
    """Neighbour lists (dist, place) after inserting the rows one after the other.

    Each row is searched for in the graph so far, from row 0, with ``budget`` results; its nearest ``degree`` become its
    neighbours, and it is offered to each of them: appended while there is room, else put in place of the farthest if
    it is nearer. A list that has just become full is sorted.
    """
    out: list[list[tuple[float, int]]] = []
    insert_more(vectors, out, metric, degree, budget)
    return out


def insert_more(vectors: np.ndarray, out: list[list[tuple[float, int]]], metric: str = "l2", degree: int = DEGREE, budget: int = BUDGET) -> set[int]:
    """Insert the rows that ``out`` has no list of yet, in place; the places of the lists that are new or have changed."""
    cap, changed = 2 * degree + 1, set()
    for v in range(len(out), len(vectors)):
        near = _nearest(vectors, out, v, metric, budget)[:degree]
        out.append(list(near))
        changed.add(v)
        for d, u in near:
            own = out[u]
            if len(own) < cap:
                own.append((d, v))
                changed.add(u)
                if len(own) == cap:
                    own.sort(key=lambda e: e[0])
            elif d < own[-1][0]:
                own.pop()
                at = bisect_left(own, d, key=lambda e: e[0])
                while at < len(own) and own[at][0] == d:  # equal ones stay in front
                    at += 1
                own.insert(at, (d, v))
                changed.add(u)
    return changed


def _nearest(vectors: np.ndarray, lists: list, v: int, metric: str, budget: int) -> list[tuple[float, int]]:
    if not v:
        return []
    q = vectors[v]
    # Few rows: all distances at once; many: those of the neighbours met.
    known = to_rows(metric, q, vectors[:v]).tolist() if v <= 8192 else None

    def of(ys: list[int]) -> list[float]:
        return [known[y] for y in ys] if known is not None else to_rows(metric, q, vectors[ys]).tolist()

    front, top, seen = [(of([0])[0], 0)], [], {0}
    while front:
        d, x = heappop(front)
        if len(top) == budget and -top[0][0] < d:
            break
        heappush(top, (-d, -x))
        if len(top) > budget:
            heappop(top)
        new = [y for _, y in lists[x] if y not in seen]
        seen.update(new)
        for e in zip(of(new), new, strict=True) if new else ():
            heappush(front, e)
    return sorted((-d, -x) for d, x in top)


EDGES = "src long, rank int, dst long, dist double"


def build_sequential(vectors: DataFrame, metric: str = "l2", degree: int = DEGREE, budget: int = BUDGET, shards: int = 1, vector: str = "embedding", shard: str | None = None) -> DataFrame:
    """(shard, src, rank, dst, dist), inserted in order of vec_id.

    Insertion is one after the other, so a shard is one task's work: more rows take more shards, by the column ``shard``
    or pmod(xxhash64(vec_id), shards), each a graph of its own, whose search results are merged.
    """
    checked(metric)
    of = F.col(shard) if shard else F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    rows = prepared(vectors, metric, "vec_id", vector, of.cast("int").alias("shard"))

    def run(key, group):
        group = group.sort_by("key").combine_chunks()
        ids = group["key"].to_numpy()
        lists = insert_all(matrix(group["v"].chunk(0), metric), metric, degree, budget)
        rows = [(key[0].as_py(), int(ids[v]), r, int(ids[u]), float(d)) for v, own in enumerate(lists) for r, (d, u) in enumerate(sorted(own), 1)]
        s, src, rank, dst, dist = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.table({"shard": pa.array(s, pa.int32()), "src": pa.array(src, pa.int64()), "rank": pa.array(rank, pa.int32()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(dist, pa.float64())})

    return rows.groupBy("shard").applyInArrow(run, "shard int, " + EDGES)


def build_in_order(vectors: DataFrame, metric: str = "l2", degree: int = DEGREE, vector: str = "embedding") -> DataFrame:
    """(src, rank, dst, dist): one graph of all rows, as inserted in order of vec_id where each row finds the nearest before it.

    What a row finds then doesn't depend on the edges, nor do the offers on their order: a list keeps the nearest of what it
    began with and was offered. So the rows before each are compared in blocks, in many tasks, and no link is left out.
    """
    near = knn(vectors, vectors, degree, metric, vector=vector, before=True).select(F.lit(0).alias("shard"), F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist")
    return _both_ways(near, degree).select("src", "rank", "dst", "dist")


def build_bulk(vectors: DataFrame, metric: str = "l2", degree: int = DEGREE, vector: str = "embedding") -> DataFrame:
    """(src, rank, dst, dist): exact neighbours and the reverse of those edges, the nearest 2 * degree + 1 of each vertex."""
    near = knn(vectors, vectors, degree, metric, vector=vector, with_self=False).select(F.lit(0).alias("shard"), F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "dist")
    return _both_ways(near, degree).select("src", "rank", "dst", "dist")


def build_descent(vectors: DataFrame, metric: str = "l2", degree: int = DEGREE, vector: str = "embedding") -> DataFrame:
    """(src, rank, dst, dist): as ``build_bulk``, from neighbours found by descent: for inputs too large to compare all pairs."""
    near, _ = descend(vectors, degree, metric, vector)
    return _both_ways(near.withColumn("shard", F.lit(0)), degree).select("src", "rank", "dst", "dist")


def build_bulk_shards(vectors: DataFrame, metric: str = "l2", degree: int = DEGREE, shards: int = 1, vector: str = "embedding") -> DataFrame:
    """(shard, src, rank, dst, dist): a bulk graph of each of ``shards`` (pmod(xxhash64(vec_id), shards)), a task for each."""
    checked(metric)
    rows = prepared(vectors, metric, "vec_id", vector, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))

    def run(key, group):
        group = group.combine_chunks()
        batch = pa.RecordBatch.from_arrays([group["key"].chunk(0), group["v"].chunk(0)], names=["key", "v"])
        own = SimpleNamespace(value=(group["key"].to_numpy(), matrix(batch.column(1), metric)))
        out = pa.Table.from_batches(nearest_in_task(own, degree, metric, False)([batch]), NEAR)
        return pa.table({"shard": pa.array([key[0].as_py()] * len(out), pa.int32()), "src": out[0], "dst": out[1], "dist": out[2]})

    return _both_ways(rows.groupBy("shard").applyInArrow(run, "shard int, src long, dst long, dist double"), degree)


def _both_ways(near: DataFrame, degree: int) -> DataFrame:
    both = near.unionByName(near.select("shard", F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    one = both.groupBy("shard", "src", "dst").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return one.withColumn("rank", rank).where(F.col("rank") <= 2 * degree + 1).select("shard", "src", "rank", "dst", "dist")


def edge_distances(edges: DataFrame, vectors: DataFrame, metric: str = "l2", vector: str = "embedding") -> DataFrame:
    """(src, dst, dist) of edges whose distances were not kept, as in raw graph files: two joins by id."""
    from nearfield.functions.distance import distance

    own = vectors.select("vec_id", F.col(vector).alias("v"))
    a, b = own.select(F.col("vec_id").alias("src"), F.col("v").alias("a")), own.select(F.col("vec_id").alias("dst"), F.col("v").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", distance(metric, "a", "b").alias("dist"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, degree) of every vertex."""
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select(F.col("vec_id").alias("src")).join(n, "src", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def statistics(vertices: DataFrame, edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """One row: vertices, edges, average degree, and vertices whose degree is not the one wanted."""
    d = degrees(vertices, edges)
    return d.agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.coalesce(F.sum((F.col("degree") != degree).cast("long")), F.lit(0)).alias("other_degree"))


def reach(vertices: DataFrame, edges: DataFrame, shard: str | None = None) -> DataFrame:
    """(vec_id, steps) of every vertex: the edges from the first vertex, of its ``shard``, to it, null if it cannot be reached.

    Each round the vertices just reached meet the edges, and what was reached before is left out; as many rounds as the
    longest of the ways. The edges are written once, so that a round does not make them again.
    """
    with Scratch(vertices.sparkSession, "reach") as s:
        links = s.write(edges.select("src", "dst"), "links")
        vertices = s.write(vertices.select("vec_id", *([shard] if shard else [])), "vertices")
        first = vertices.groupBy(*([shard] if shard else [])).agg(F.min("vec_id").alias("vec_id"))
        now = s.write(first.where("vec_id IS NOT NULL").select("vec_id", F.lit(0).alias("steps")), "reached")
        reached, step = now, 0
        while not now.isEmpty():
            step += 1
            met = now.select(F.col("vec_id").alias("src")).join(links, "src").select(F.col("dst").alias("vec_id")).distinct()
            now = s.write(met.join(reached, "vec_id", "left_anti").select("vec_id", F.lit(step).alias("steps")), "reached")
            reached = reached.unionByName(now)
        return materialize(vertices.select("vec_id").join(reached, "vec_id", "left"), "reach")


def bridged(vectors: DataFrame, edges: DataFrame, metric: str = "l2", degree: int = DEGREE, vector: str = "embedding") -> DataFrame:
    """``edges`` (src, rank, dst, dist) with further ones, so that every vertex is reached from the first one.

    A vertex that is not reached gets an edge from the nearest one that is, in place of the farthest if that one's list
    is full. What is lost by that is found by the next round; edges of a repair are never given up, so that rounds end,
    and a vertex that is the nearest of very many lost ones may have more edges than the cap.
    """
    cap, fixed = 2 * degree + 1, None
    with Scratch(vectors.sparkSession, "bridges") as s:
        while True:
            lost = reach(vectors, edges)
            far = s.write(vectors.join(lost.where("steps IS NULL").select("vec_id"), "vec_id", "left_semi"), "lost")
            if far.isEmpty():
                return materialize(edges, "bridged")
            known = vectors.join(lost.where("steps IS NOT NULL").select("vec_id"), "vec_id", "left_semi")
            new = knn(far, known, 1, metric, vector=vector).select(F.col("vec_id").alias("src"), F.col("query_id").alias("dst"), "dist", F.lit(True).alias("kept"))
            fixed = s.write(new if fixed is None else fixed.unionByName(new), "fixed")
            every = edges.join(fixed.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "dist", F.lit(False).alias("kept")).unionByName(fixed)
            order = Window.partitionBy("src").orderBy(F.desc("kept"), "dist", "dst")
            room = every.withColumn("r", F.row_number().over(order)).where((F.col("r") <= cap) | F.col("kept"))
            rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
            edges = s.write(room.withColumn("rank", rank).select("src", "rank", "dst", "dist"), "edges")


def without(vectors: DataFrame, edges: DataFrame, gone: DataFrame, metric: str = "l2", degree: int = DEGREE, vector: str = "embedding") -> DataFrame:
    """``edges`` (shard, src, rank, dst, dist) without the vertices ``gone`` (vec_id); ``vectors`` are those that stay.

    Whoever had a neighbour that goes is offered that one's own neighbours in its place, by their distances. Each lost
    edge brings at most as many offers as a vertex has edges.
    """
    left = edges.join(gone.withColumnRenamed("vec_id", "src"), "src", "left_anti")
    lost = left.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_semi").select("shard", "src", F.col("dst").alias("via"))
    own = edges.join(gone.withColumnRenamed("vec_id", "src"), "src", "left_semi").join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_anti").select(F.col("src").alias("via"), "dst")
    kept = left.join(gone.withColumnRenamed("vec_id", "dst"), "dst", "left_anti").select("shard", "src", "dst", "dist")
    offers = lost.join(own, "via").where("src <> dst").select("shard", "src", "dst").distinct().join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
    offers = offers.join(edge_distances(offers, vectors, metric, vector), ["src", "dst"]).select("shard", "src", "dst", "dist")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return kept.unionByName(offers).withColumn("rank", rank).where(F.col("rank") <= 2 * degree + 1).select("shard", "src", "rank", "dst", "dist")


def head(edges: DataFrame, first: int = 10) -> DataFrame:
    """Edges of the vertices under an id."""
    return edges.where(F.col("src") < first)


def violations(vertices: DataFrame, edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(rule, n): how often a built graph breaks what always holds; all 0."""
    own = edges.where("src = dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit("self loop").alias("rule"), "n")
    twice = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated edge").alias("rule"), "n")
    many = degrees(vertices, edges).where(F.col("degree") > 2 * degree + 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("over the cap").alias("rule"), "n")
    none = degrees(vertices, edges).where("degree = 0").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no edge").alias("rule"), "n")
    return own.unionByName(twice).unionByName(many).unionByName(none)


def recall(found: DataFrame, exact: DataFrame, k: int, first: int | None = None) -> DataFrame:
    """(k, queries, recall): the part of the exact ``k`` nearest that is among the ``first`` found, k unless given."""
    e = exact.where(F.col("rank") <= k)
    hit = found.where(F.col("rank") <= (first or k)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return e.join(hit, ["query_id", "vec_id"], "left").agg(F.lit(k).alias("k"), F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
