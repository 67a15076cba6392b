"""Graphs kept by a stream against those of a batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearfield.operators import graph
from nearfield.plans.index import VectorIndex
from nearfield.streaming import insert

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in r]) for i, r in enumerate(x)], SCHEMA)


def arrive(spark, path, batch):
    batch.coalesce(1).write.mode("append").parquet(f"{path}/in")


def inserted(spark, path, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return insert.run(insert.insert_stream(stream, **more), f"{path}/out", f"{path}/checkpoint")


def rows(df):
    return sorted(map(tuple, df.select("shard", "src", "rank", "dst", "dist").collect()))


def test_stream_builds_the_graphs_of_a_batch(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(240, 6))
    x[100:120] = x[0:20]  # copies, whose distances tie
    for at in (0, 80, 160):
        arrive(spark, tmp_path, frame(spark, x[at : at + 80], at))
    changes = inserted(spark, tmp_path, shards=2, degree=4, budget=20)
    vectors, edges = insert.latest(changes)
    want = graph.build_sequential(frame(spark, x), degree=4, budget=20, shards=2)
    assert rows(edges) == rows(want)
    assert sorted(r["vec_id"] for r in vectors.collect()) == list(range(240))
    batch = VectorIndex(frame(spark, x).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(2)).cast("int")), want, "l2", 2)
    asked = frame(spark, x[::10])
    assert sorted(insert.index_of(changes, shards=2).search_batch(asked, 10).collect()) == sorted(batch.search_batch(asked, 10).collect())


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(120, 5))
    arrive(spark, tmp_path, frame(spark, x[:50]))
    before = inserted(spark, tmp_path, degree=4, budget=20).count()
    arrive(spark, tmp_path, frame(spark, x[50:], 50))
    changes = inserted(spark, tmp_path, degree=4, budget=20)
    assert changes.count() > before
    assert rows(insert.latest(changes)[1]) == rows(graph.build_sequential(frame(spark, x), degree=4, budget=20))


def test_stream_leaves_out_repeats_and_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(0, [9.0, 9.0]), (None, [1.0, 1.0]), (7, None), (8, [None, 1.0])], SCHEMA)
    arrive(spark, tmp_path, frame(spark, np.eye(2)))
    arrive(spark, tmp_path, odd)
    arrive(spark, tmp_path, odd.limit(0))
    arrive(spark, tmp_path, frame(spark, [[2.0, 2.0]], 5))
    vectors, edges = insert.latest(inserted(spark, tmp_path))
    assert sorted((r["vec_id"], r["embedding"]) for r in vectors.collect()) == [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [2.0, 2.0])]
    assert edges.where(F.col("src") == 5).count() == 2
