"""Exact top-k inner products by term-at-a-time accumulation.

Candidates are turned into posting lists, a block at a time: for each component the rows that have it and their
weights. A query scatters its own weights, component by component, over a dense array of scores; a partition of that
array selects the best, which are merged with the best so far. All queries meet all candidates, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, materialize

#: Components are held at this value at most, so that products of 64 of them fit 64 bits.
MOST = 1 << 28
#: Candidates that are scored at once, and bytes of queries that are sent to the executors at a time.
BLOCK, QUERY_BYTES = 8192, 16 << 20


def integer_components(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(key, v array<long>): floor(scale * x) of every component; rows without a key, a vector, or with a null or non-finite component go.

    Values beyond plus or minus MOST are held there: scores of larger ones are no 64-bit integers.
    """
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(whole).select(F.col(key).alias("key"), F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c * F.lit(float(scale))))).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of any length, cut or filled with 0 to ``width``: what the other side lacks adds nothing to a product."""
    values, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


class Best:
    """The k best candidates of each query so far: higher score first, then smaller key."""

    def __init__(self, keys: np.ndarray, queries: np.ndarray, k: int):
        self.keys, self.k = keys, k
        self.terms = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in queries]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in keys]

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        postings = [np.flatnonzero(c) for c in vectors.T]
        dense = [len(p) == len(keys) for p in postings]
        weights = [np.ascontiguousarray(vectors[p, t]) for t, p in enumerate(postings)]
        for i, (terms, own) in enumerate(self.terms):
            score = np.zeros(len(keys), np.int64)
            for t, w in zip(terms.tolist(), own.tolist(), strict=True):
                if dense[t]:
                    score += w * weights[t]
                else:
                    score[postings[t]] += w * weights[t]
            at = np.flatnonzero(keys != self.keys[i])
            if len(at) > self.k:
                least = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= least]  # ties at the edge stay until keys decide
            s, v = np.concatenate([self.found[i][0], score[at]]), np.concatenate([self.found[i][1], keys[at]])
            order = np.lexsort((v, -s))[: self.k]
            self.found[i] = s[order], v[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (key, v).

    A query's own key is no candidate. Query rows of one key are one query, whose list has the best scores that any of
    them gives, a candidate once for each row and vector. Ties go to the smaller vec_id; repeated rows are candidates each for itself;
    with fewer than k candidates all are returned; without queries or candidates there are no rows. Products are of
    64 bits. Queries are sent QUERY_BYTES at a time, each batch as a job of its own if there are several.
    """
    spark = candidates.sparkSession
    q = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(q["w"] or 0, 1)
    batches = max(1, -(-(q["n"] or 0) * width * 8 // QUERY_BYTES))
    if batches == 1:
        return _ranked([_of_batch(queries, candidates, width, k)], k)
    with Scratch(spark, "topk") as s:  # QUERY_BYTES a batch, give or take a hash's unevenness
        mine = (queries.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b) for b in range(batches))
        return materialize(_ranked([s.write(_of_batch(m, candidates, width, k), "batch") for m in mine], k), "topk")


def _of_batch(queries: DataFrame, candidates: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each task. It sends k rows a query and task to the ranking."""
    rows = queries.distinct().toArrow().combine_chunks()
    if not rows.num_rows:
        return candidates.sparkSession.createDataFrame([], _SCORES)
    shared = candidates.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(), _matrix(rows["v"].chunk(0), width)))
    return candidates.mapInArrow(_scorer(shared, width, k), _SCORES)


_SCORES = "query_id long, vec_id long, score long"


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    every, *more = parts
    for part in more:
        every = every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scorer(shared, width: int, k: int):
    def run(batches):
        best = Best(*shared.value, k)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                best.add(part.column(0).to_numpy(), _matrix(part.column(1), width))
        size = [len(s) for s, _ in best.found]
        if sum(size):
            score, key = (np.concatenate(x) for x in zip(*best.found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.keys, size)), pa.array(key), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
