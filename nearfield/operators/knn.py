"""Exact nearest neighbours: every query against every vector, in blocks."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import Asked, between, checked, pairwise

#: Bytes of queries that are sent to the executors at a time, vectors compared at once, values of a block of distances, and
#: candidates of a query, in multiples of k, beyond which the block's own k nearest are found first.
QUERY_BYTES, VECTORS, BLOCK_VALUES, CROWD = 32 << 20, 8192, 1 << 19, 4
#: Vectors that a task compares first, how many times those before it compares next, pairs whose distances are computed at once.
FIRST, GROWTH, PAIRS = 256, 2, 8192
#: Parts of QUERY_BYTES of vectors that are dealt out over all cores; QUERY_BYTES of queries or vectors, as doubles, in a task where
#: both are in parts, and the least number of such tasks for each core.
SPREAD, HELD, TASKS = 32, 2, 3
RESULT = "query_id long, rank int, vec_id long, dist double"


def matrix(column: pa.Array, metric: str) -> np.ndarray:
    """Rows of one length; others raise ValueError."""
    kind = np.int64 if metric == "hamming" else np.float64
    if not len(column):
        return np.zeros((0, 0), kind)
    size = np.diff(column.offsets.to_numpy())
    if (size != size[0]).any():
        raise ValueError(f"vectors have {size.min()} to {size.max()} components; all must have the same number")
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def prepared(vectors: DataFrame, metric: str, key: str, vector: str, *more) -> DataFrame:
    """(key, v, ``more``) of rows that have a key and a vector without null components, in the type that the metric computes in."""
    v = F.col(vector).cast("array<long>" if metric == "hamming" else "array<double>")
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    return vectors.where(whole).select(F.col(key).cast("long").alias("key"), v.alias("v"), *more)


def as_given(rows: DataFrame, vectors: DataFrame, vector: str) -> DataFrame:
    """Prepared rows with floats where the vectors were given so: the same numbers in half the bytes, for rows that are sent."""
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>" and rows.schema["v"].dataType.simpleString() == "array<double>"
    return rows.withColumn("v", F.col("v").cast("array<float>")) if floats else rows


def _first_of_each(group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
    nth = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return np.flatnonzero(nth < k)


def _near(about: np.ndarray, off: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a block that may be among the k nearest: at most ``least``, or than what the block's own k
    nearest allow where there is no such bound or it leaves a crowd. ``about`` may be off by ``off``."""
    near = about <= least[:, None]
    if not np.isfinite(least).all() or np.count_nonzero(near) > CROWD * k * len(near):
        n = min(k, about.shape[1]) - 1
        least = np.minimum(np.partition(about, n, axis=1)[:, n] + 2 * off, least).astype(about.dtype)
        near = about <= np.nextafter(least, np.inf, dtype=about.dtype)[:, None]
    at = np.flatnonzero(near)
    q, v = np.divmod(at, about.shape[1])
    finite = about.ravel()[at] < np.inf
    return q[finite], v[finite]


def _distances(metric: str, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows ``x`` of one matrix and rows ``y`` of another, some at a time."""
    return np.concatenate([np.zeros(0), *(pairwise(metric, a[x[i : i + PAIRS]], b[y[i : i + PAIRS]]) for i in range(0, len(x), PAIRS))])


def _by_query(q: np.ndarray, d: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The order by query, one of ``n``, distance and id: by distance, then dealt out to the queries; ids only where distances tie."""
    order = np.argsort(d)
    order = order[np.argsort(q[order].astype(np.uint16) if n <= 1 << 16 else q[order], kind="stable")]
    a, b = q[order], d[order]
    tied = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    if tied.any():
        some = np.zeros(n, bool)
        some[a[1:][tied]] = True
        at = np.flatnonzero(some[a])
        own = order[at]
        order[at] = own[np.lexsort((x[own], d[own], q[own]))]
    return order


def nearest_in_task(shared, k: int, metric: str, with_self: bool, before: bool = False):
    """Per query the k nearest of all rows of a task: candidates by a matrix product, their distances pair by pair.

    With ``before`` only rows of lesser keys than the query's are candidates.

    The product is in single precision with a bound on its error, in double where that leaves a crowd; codes
    are compared word by word. The first rows
    compared are few, so that there is a bound for the many after them.
    """

    def run(batches):
        keys, queries = shared.value
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, distance, id
        bound = np.full(len(keys), np.inf)
        asked, seen = Asked(metric, queries), 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, min(VECTORS, max(FIRST, GROWTH * seen)))
                at, seen = at + part.num_rows, seen + part.num_rows
                ids, m = part.column(0).to_numpy(), matrix(part.column(1), metric)
                finite = np.isfinite(m).all(1)
                ids, m = ids[finite], m[finite]
                if not len(ids):
                    continue
                if len(keys) and m.shape[1] != queries.shape[1]:
                    raise ValueError(f"queries have {queries.shape[1]} components, vectors {m.shape[1]}")
                found, meeting = [], asked.meets(m)
                order = np.argsort(ids, kind="stable")
                step = max(1, BLOCK_VALUES // len(ids))
                for i in range(0, len(keys), step):
                    block = slice(i, i + step)

                    def without_self(about, own=keys[block], ids=ids, order=order):
                        if before:
                            about[ids >= own[:, None]] = np.inf
                        elif not with_self:
                            first, last = (np.searchsorted(ids, own, side, order) for side in ("left", "right"))
                            for r in np.flatnonzero(last > first).tolist():
                                about[r, order[first[r] : last[r]]] = np.inf
                        return about

                    q = None
                    if meeting:
                        most = meeting.most(block, bound[block]).astype(np.float32)
                        q, v = _near(without_self(meeting.scores(block)), meeting.off[block], most, k)
                        if metric != "hamming" and len(q) > 2 * CROWD * k * len(most):  # scores of codes are exact
                            q = None
                    if q is None:
                        about, off = between(metric, queries[block], m)
                        q, v = _near(without_self(about), off, bound[block] + 2 * off, k)
                    if len(q):
                        found.append([q + i, _distances(metric, queries, q + i, m, v), ids[v]])
                if not found:
                    continue
                new = [np.concatenate(c) for c in zip(*found, strict=True)]
                hit = np.zeros(len(keys), bool)
                hit[new[0]] = True
                again = hit[best[0]]
                q, d, x = (np.concatenate((old[again], own)) for old, own in zip(best, new, strict=True))
                order = _by_query(q, d, x, len(keys))
                order = order[_first_of_each(q[order], k)]
                q, d, x = q[order], d[order], x[order]
                last = np.flatnonzero(np.concatenate((q[1:] != q[:-1], [True])))
                bound[q[last]] = np.where(np.bincount(q, minlength=len(keys))[q[last]] == k, d[last], np.inf)
                best = [np.concatenate((old[~again], own)) for old, own in zip(best, (q, d, x), strict=True)]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(keys[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "dist"])

    return run


def _parts(rows: DataFrame) -> int:
    """Parts of prepared rows that hold QUERY_BYTES each."""
    q = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    return max(1, -(-(q["n"] or 0) * (q["w"] or 1) * 8 // QUERY_BYTES))


def _spread(rows: DataFrame) -> DataFrame:
    """Up to SPREAD parts are dealt out over all cores, however few files or row groups they come from; more stay where they are."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if _parts(rows) <= SPREAD else rows


def query_batches(queries: DataFrame):
    """Broadcasts of (keys, matrix) that together hold all queries, each of QUERY_BYTES, give or take a hash's unevenness."""
    spark, n = queries.sparkSession, _parts(queries)
    for i in range(n):
        rows = (queries.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i) if n > 1 else queries).toArrow().combine_chunks()
        if rows.num_rows:
            v = rows["v"].chunk(0)
            yield n, spark.sparkContext.broadcast((rows["key"].to_numpy(), matrix(v, "hamming" if v.type.value_type == pa.int64() else "l2")))


def ranked(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def _in_parts(asked: DataFrame, base: DataFrame, k: int, metric: str, with_self: bool, n: int, before: bool = False) -> DataFrame:
    """Each part of the queries, of ``n`` times QUERY_BYTES in all, meets each part of the vectors in a task; nothing passes through the driver.

    A row is sent once for each part of the other side, so the parts are as many on both sides and no more than tasks and
    their memory ask for.
    """
    least = TASKS * base.sparkSession.sparkContext.defaultParallelism
    n = max(-(-n // HELD), math.isqrt(least - 1) + 1)
    m = max(-(-_parts(base) // HELD), -(-least // n))
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(every(n).alias("q"), part(m).cast("int").alias("p"), "key", "v")
    right = asked.select(part(n).cast("int").alias("q"), every(m).alias("p"), "key", "v")

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], NEAR)
        right = right.combine_chunks()
        shared = SimpleNamespace(value=(right["key"].to_numpy(), matrix(right["v"].chunk(0), metric)))
        return pa.Table.from_batches(nearest_in_task(shared, k, metric, with_self, before)(left.select(["key", "v"]).to_batches()), NEAR)

    return left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInArrow(run, "query_id long, vec_id long, dist double")


NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", query_key: str = "vec_id", key: str = "vec_id", vector: str = "embedding", with_self: bool = True, before: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, dist): exact, by (dist, vec_id).

    Vectors stay where they are, or are dealt out if they are few, and the queries are sent to them; more queries than QUERY_BYTES meet the vectors part by
    part. A task keeps k rows for each query, and only those go to the ranking. Without
    ``with_self`` a row of the query's own key is no candidate, with ``before`` none but those of lesser keys. Rows without a key or a vector, or with a null component,
    take no part, nor do vectors with components that are no numbers or infinite; vectors of different lengths raise.
    """
    checked(metric)
    base, asked = prepared(vectors, metric, key, vector), prepared(queries, metric, query_key, vector)
    if (n := _parts(asked)) > 1:
        return ranked(_in_parts(as_given(asked, queries, vector), as_given(base, vectors, vector), k, metric, with_self, n, before), k)
    for _, shared in query_batches(asked):
        return ranked(_spread(base).mapInArrow(nearest_in_task(shared, k, metric, with_self, before), "query_id long, vec_id long, dist double"), k)
    return vectors.sparkSession.createDataFrame([], RESULT)


def real_nn(queries: DataFrame, vectors: DataFrame, query_key: str = "vec_id", key: str = "vec_id", with_self: bool = False) -> DataFrame:
    """(query_id, dist): the least squared L2 distance, whatever metric an index has."""
    return knn(queries, vectors, 1, "l2", query_key, key, with_self=with_self).select("query_id", "dist")
