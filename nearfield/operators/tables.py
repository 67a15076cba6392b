"""Candidates from several tables of hyperplane codes: vectors that share a bucket with a query in any table.

A table is a band of the hyperplanes' bits. A query looks into its own bucket and into those that differ in the bit of
the smallest margin, the next smallest and so on. A bucket with very many vectors is split by salts, to all of which its
queries go, so that no task has a whole one.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import checked
from nearfield.functions.hashing import hyperplanes
from nearfield.operators.knn import NEAR, matrix, nearest_in_task, prepared, ranked
from nearfield.shared import materialize

#: Vectors of a bucket that meet queries in one task, and queries that they meet at a time.
SALT_ROWS, TURN_ROWS = 4096, 16384


def buckets(vectors: DataFrame, tables: int, bits: int, probes: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, table, probe, bucket): the bucket of each table is probe 0, then come those with one bit changed, by margin.

    Bit j of table t is hyperplane t * bits + j. Ties of margins go to the lower bit. Rows that ``prepared`` leaves out
    have no buckets.
    """
    looks = _looks(vectors, tables, bits, probes, key, vector).select("key", F.posexplode("looks").alias("at", "bucket"))
    return looks.select("key", F.floor(F.col("at") / probes).cast("int").alias("table"), (F.col("at") % probes).alias("probe"), "bucket")


def _looks(vectors: DataFrame, tables: int, bits: int, probes: int, key: str, vector: str) -> DataFrame:
    """(key, v, looks): the buckets of a row's tables, ``probes`` of each table after another."""
    if not 0 < bits < 63 or not 0 < probes <= bits + 1:
        raise ValueError(f"1 to 62 bits and 1 to bits + 1 probes, not {bits} and {probes}")

    def run(batches):
        planes = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column(1), "l2")
                planes = hyperplanes(tables * bits, x.shape[1]) if planes is None else planes
                margin = (x @ planes.T).reshape(len(x), tables, bits)
                bucket = ((margin >= 0).astype(np.int64) << np.arange(bits)).sum(2)
                flips = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, : probes - 1]
                every = np.concatenate([bucket[:, :, None], bucket[:, :, None] ^ (np.int64(1) << flips)], axis=2)
                looks = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * tables * probes, pa.array(every.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, looks], names=["key", "v", "looks"])

    return prepared(vectors, "l2", key, vector).mapInArrow(run, "key long, v array<double>, looks array<long>")


def _dealt(queries: DataFrame, vectors: DataFrame, tables: int, bits: int, probes: int, query_key: str, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(table, bucket, salt, turn, vec_id, v, own) and (table, bucket, salt, turn, query_id, v, looks), which meet by the first four.

    A bucket of many vectors has several salts, one of many queries several turns; each meets each.
    """
    at = ["table", "bucket"]

    def size(looks: DataFrame, n: int, rows: int, name: str) -> DataFrame:
        long = looks.select(F.posexplode("looks").alias("at", "bucket")).select(F.floor(F.col("at") / n).cast("int").alias("table"), "bucket")
        return long.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    own, asked = _looks(vectors, tables, bits, 1, key, vector), _looks(queries, tables, bits, probes, query_key, vector)
    large = size(own, 1, SALT_ROWS, "salts").join(size(asked, probes, TURN_ROWS, "turns"), at).where("salts > 1 OR turns > 1")
    large = materialize(large, "large")  # at most a row for every SALT_ROWS vectors or TURN_ROWS queries of a table
    salts, turns = F.coalesce("salts", F.lit(1)), F.coalesce("turns", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = own.select("key", "v", F.col("looks").alias("own"), F.posexplode("looks").alias("table", "bucket")).join(large, at, "left")
    own = own.select(*at, F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), every(turns).alias("turn"), F.col("key").alias("vec_id"), "v", "own")
    asked = asked.select("key", "v", "looks", F.posexplode("looks").alias("at", "bucket")).withColumn("table", F.floor(F.col("at") / probes).cast("int")).join(large, at, "left")
    asked = asked.select(*at, every(salts).alias("salt"), F.pmod(F.xxhash64("key"), turns).cast("int").alias("turn"), F.col("key").alias("query_id"), "v", "looks")
    return own, asked


def _repeats(rows: DataFrame, key: str) -> bool:
    return rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count() > 0


def candidates(queries: DataFrame, vectors: DataFrame, tables: int = 8, bits: int = 12, probes: int = 3, query_key: str = "vec_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id): each pair of a query and a vector that meet in some bucket, once."""
    own, asked = _dealt(queries, vectors, tables, bits, probes, query_key, key, vector)
    pairs = asked.drop("v").join(own.drop("v"), ["table", "bucket", "salt", "turn"])
    before = F.lit(False)  # a pair that has met in a table before is not told again
    for t in range(tables - 1):
        before = before | (F.col("table") > t) & F.array_contains(F.slice("looks", t * probes + 1, probes), F.col("own")[t])
    pairs = pairs.where(~before).select("query_id", "vec_id")
    return pairs.distinct() if _repeats(queries, query_key) or _repeats(vectors, key) else pairs


def _nearest_of_bucket(k: int, metric: str):
    def run(left, right):
        near = pa.Table.from_batches([], NEAR)
        if left.num_rows and right.num_rows:
            left, right = left.select(["vec_id", "v"]).combine_chunks(), right.combine_chunks()
            asked = SimpleNamespace(value=(right["query_id"].to_numpy(), matrix(right["v"].chunk(0), metric)))
            near = pa.Table.from_batches(nearest_in_task(asked, k, metric, True)(left.to_batches()), NEAR)
        return near

    return run


def search_tables(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", tables: int = 8, bits: int = 12, probes: int = 3, query_key: str = "vec_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, dist): the nearest of the candidates by their exact distances; fewer where there are fewer.

    Queries and vectors meet where their bucket is and only a query's ``k`` nearest of it leave: pairs are never written.
    """
    checked(metric)
    own, asked = _dealt(queries, vectors, tables, bits, probes, query_key, key, vector)
    at, kind = ["table", "bucket", "salt", "turn"], "long" if metric == "hamming" else "double"
    own, asked = (x.withColumn("v", F.col("v").cast(f"array<{kind}>")).drop("own", "looks") for x in (own, asked))
    near = own.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(_nearest_of_bucket(k, metric), "query_id long, vec_id long, dist double")
    return ranked(near.repartition("query_id").dropDuplicates(["query_id", "vec_id"]), k)
