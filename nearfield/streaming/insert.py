"""Vectors that arrive as a stream and are inserted into graphs that the stream keeps as its state, one for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearfield.functions.distance import checked
from nearfield.operators.graph import BUDGET, DEGREE, insert_more
from nearfield.operators.knn import prepared
from nearfield.plans.index import VectorIndex

#: A vertex after an insertion: its neighbours, and how many vertices the shard had by then. Only its first row has the vector.
CHANGES = "shard int, src long, size long, embedding array<double>, dst array<long>, dist array<double>"
#: What the state store needs for several state variables of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Inserter(StatefulProcessor):
    """A shard's graph: a map of places to (id, vector, places and distances of neighbours) in the order of the lists."""

    def __init__(self, metric: str, degree: int, budget: int):
        self.metric, self.degree, self.budget = metric, degree, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.graph = handle.getMapState("graph", "place long", "id long, v array<double>, near array<long>, dist array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((int(place[0]), value) for place, value in self.graph.iterator()) if self.graph.exists() else []
        ids = [int(v[0]) for _, v in held]
        lists = [[(float(d), int(u)) for d, u in zip(v[3], v[2], strict=True)] for _, v in held]
        vectors, known = [np.asarray(v[1], float) for _, v in held], set(ids)
        first = len(ids)
        new = pd.concat(list(rows)).sort_values("vec_id", kind="stable")
        for i, v in zip(new["vec_id"].tolist(), new["embedding"], strict=True):
            if i not in known:
                known.add(i)
                ids.append(i)
                vectors.append(np.asarray(v, float))
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("vectors of a stream must all have the same number of components")
        if len(ids) == first:
            return
        m = np.stack(vectors)
        changed = sorted(insert_more(m.astype(np.int64) if self.metric == "hamming" else m, lists, self.metric, self.degree, self.budget))
        out = []
        for p in changed:
            near, dist = [u for _, u in lists[p]], [d for d, _ in lists[p]]
            self.graph.updateValue((p,), (ids[p], vectors[p].tolist(), near, dist))
            out.append((key[0], ids[p], len(ids), vectors[p].tolist() if p >= first else None, [ids[u] for u in near], dist))
        yield pd.DataFrame(out, columns=["shard", "src", "size", "embedding", "dst", "dist"])

    def close(self) -> None:
        pass


def insert_stream(vectors: DataFrame, metric: str = "l2", shards: int = 1, degree: int = DEGREE, budget: int = BUDGET) -> DataFrame:
    """The changes (CHANGES) of the graphs of pmod(xxhash64(vec_id), shards) as the stream's vectors are inserted into them.

    A micro-batch is inserted in order of vec_id after those before it. If ids ascend from batch to batch, the graphs are
    those of a batch insertion. Ids that are there already and rows without an id, a vector or a component are left out.

    The state store keeps the graphs; a micro-batch reads the shards that it has rows for and writes the vertices that it
    changes, so a shard must fit a task, as in a batch, and batches should not be single rows. The query needs Spark's
    RocksDB store: ``spark.sql.streaming.stateStore.providerClass`` = STORE. After a failure a micro-batch is run again from
    the state before it, and a sink that takes each batch once (files, Delta and the like) has each change once.
    """
    checked(metric)
    rows = prepared(vectors, metric, "vec_id", "embedding").select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.col("key").alias("vec_id"), F.col("v").alias("embedding"))
    return rows.groupBy("shard").transformWithStateInPandas(Inserter(metric, degree, budget), CHANGES, "Append", "None")


def run(changes: DataFrame, path: str, checkpoint: str, **trigger) -> DataFrame:
    """Write a stream of changes to Parquet files until what is there now has arrived; the table of all changes so far."""
    spark, name = changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        started = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before)
    started.awaitTermination()
    return spark.read.schema(CHANGES).parquet(path)


def latest(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, vec_id, embedding) and (shard, src, rank, dst, dist) after all ``changes`` that a sink has."""
    last = changes.groupBy("shard", "src").agg(F.max_by(F.struct("dst", "dist"), "size").alias("near"))
    # A list has few entries: ranked where it is, without a window over all edges.
    ranked = last.select("shard", "src", F.posexplode(F.array_sort(F.arrays_zip("near.dist", "near.dst"))).alias("at", "e"))
    edges = ranked.select("shard", "src", (F.col("at") + 1).alias("rank"), "e.dst", "e.dist")
    return changes.where("embedding IS NOT NULL").select("shard", F.col("src").alias("vec_id"), "embedding"), edges


def index_of(changes: DataFrame, metric: str = "l2", shards: int = 1) -> VectorIndex:
    """The index of all vectors inserted so far."""
    vectors, edges = latest(changes)
    return VectorIndex(vectors, edges, checked(metric), shards)
