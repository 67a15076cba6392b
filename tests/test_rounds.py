"""Searches by rounds of joins against the ones in memory; building by descent; reachability and its repair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import hashing
from nearfield.operators import descent, graph, knn, rounds, search
from nearfield.plans.index import VectorIndex
from nearfield.sources import vectors as files


@pytest.fixture(scope="module")
def cloud(spark):
    """Whole numbers: distances are exact and often tie."""
    x = np.round(np.random.default_rng(8).normal(size=(300, 6)) * 5)
    x[50:60] = x[40:50]
    v = spark.createDataFrame([(3 * i + 1, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()
    return v, graph.build_bulk(v, degree=4).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


OPTIONS = [search.bounded("l2", 9), search.unbounded("cos", 9), search.bounded("ip", 5, finish=3), search.Options("l2", 7, bounded=True), search.Options("l2", 7, forget=True, on_insert=True)]


@pytest.mark.parametrize("o", OPTIONS)
def test_rounds_find_what_the_search_in_memory_finds(cloud, o):
    """Ids, distances and the number of expanded vertices, for all ways to keep the frontier and the visits."""
    v, e = cloud
    q = v.where("vec_id % 31 = 1")
    run = lambda way: rows(search._run(q, v, e, o, "vec_id", "embedding", None, False, way))
    assert run(True) == run(False)


def test_rounds_take_several_steps_at_once(cloud, monkeypatch):
    v, e = cloud
    q, made, real = v.where("vec_id < 30"), [], rounds.Scratch.next
    monkeypatch.setattr(rounds.Scratch, "next", lambda s, df, tag: made.append(tag) or real(s, df, tag))
    want = rows(search.search(q, v, e, search.bounded("l2", 25), 25))
    assert rows(search.search(q, v, e, search.bounded("l2", 25), 25, rounds=True)) == want
    assert made.count("wanted") < 15  # a search expands 25 vertices at least


def test_walks_and_codes_in_rounds(spark, cloud):
    v, e = cloud
    assert rows(search.greedy_walk(v, v, e, rounds=True)) == rows(search.greedy_walk(v, v, e))
    c = hashing.codes(v, 32)
    near = graph.build_bulk(c, "hamming", 4, "words")
    q, o = c.where("vec_id % 31 = 1"), search.bounded("hamming", 8)
    assert rows(search.search(q, c, near, o, vector="words", rounds=True)) == rows(search.search(q, c, near, o, vector="words"))
    assert search.search(q.limit(0), c, near, o, vector="words", rounds=True).count() == 0
    assert search.search(q, c.limit(0), near, o, vector="words", rounds=True).count() == 0
    with pytest.raises(ValueError, match="exact visited sets"):
        search.search(v, v, e, search.Options("l2", 9, visited="bloom"), rounds=True)


def test_large_raw_graph_is_searched_in_rounds(spark, tmp_path, monkeypatch):
    """Beyond the size that is sent out, an index of a user's files gives the same rows."""
    x = np.random.default_rng(1).normal(size=(500, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    files.write_raw_vectors(v, str(tmp_path / "v"))
    files.write_raw_graph(v, graph.build_bulk(v), str(tmp_path / "g"))
    index = VectorIndex.from_raw(spark, str(tmp_path / "v"), str(tmp_path / "g"), 16)
    q = index.vectors.where("vec_id % 25 = 0")
    want, one = rows(index.search_batch(q, 10)), index.search(x[3].tolist(), 5)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 10_000)
    assert rows(index.search_batch(q, 10)) == want and index.search(x[3].tolist(), 5) == one
    assert rows(index.walk(q)) == rows(search.greedy_walk(q, index.vectors, index.edges, rounds=True))


def test_edges_to_nowhere_and_repeated_edges(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(i, r, d) for i in range(20) for r, d in enumerate([99, i + 1, i + 1, i], 1)], "src long, rank int, dst long")
    got = search.search(v.where("vec_id = 7"), v, e, search.unbounded("l2", 30), rounds=True)
    assert sorted(r["vec_id"] for r in got.collect()) == list(range(20))


def test_explored_of_shards(cloud):
    v, _ = cloud
    parts = v.withColumn("shard", (F.col("vec_id") % 2).cast("int"))
    e = graph.build_bulk(v.where("vec_id % 2 = 0"), degree=4).withColumn("shard", F.lit(0)).unionByName(graph.build_bulk(v.where("vec_id % 2 = 1"), degree=4).withColumn("shard", F.lit(1)))
    q, o, want = v.where("vec_id < 40"), search.unbounded("l2", 5), {}
    for i in (0, 1):
        for r in search.explored(q, v.where(f"vec_id % 2 = {i}"), e.where(f"shard = {i}").drop("shard"), o).collect():
            a, b = want.get(r["query_id"], (0, 0))
            want[r["query_id"]] = a + r["n_found"], b + r["n_expanded"]
    assert {r["query_id"]: (r["n_found"], r["n_expanded"]) for r in search.explored(q, parts, e, o, shard="shard").collect()} == want


# --- descent -------------------------------------------------------------------------------------


def curved(n, seed=0):
    """Groups on a plane of six dimensions, bent into 32."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(20, 6))[rnd.integers(0, 20, n)] * 2 + rnd.normal(size=(n, 6))
    return np.tanh(x @ rnd.normal(size=(6, 32)) / 4) + rnd.normal(size=(n, 32)) * 0.01


@pytest.mark.parametrize("metric", ["l2", "cos"])
def test_descent_finds_the_nearest(spark, metric):
    """Nineteen of twenty neighbours, after comparing a small part of all pairs; no self, no repeats, true distances."""
    n = 4000
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(curved(n))], "vec_id long, embedding array<float>").repartition(4).cache()
    near, about = descent.descend(v, 15, metric)
    found = near.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id"), F.lit(1).alias("rank"))
    assert graph.recall(found, knn.knn(v, v, 15, metric, with_self=False), 15).first()["recall"] >= 0.95
    assert about["compared"] < 0.3 * n * n / 2 and about["changes"][-1] <= descent.ENOUGH * n * 15
    assert near.where("src = dst").count() == 0 and near.count() == near.select("src", "dst").distinct().count() == n * 15
    want = {(r["src"], r["dst"]): r["dist"] for r in graph.edge_distances(near.limit(200), v, metric).collect()}
    for r in near.join(spark.createDataFrame(list(want), "src long, dst long"), ["src", "dst"]).collect():
        assert r["dist"] == pytest.approx(want[r["src"], r["dst"]], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_descent_of_few_rows(spark, n):
    """With fewer than k others all are found."""
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)] + [(100, None), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r["src"], r["dst"]) for r in descent.descend(v, 15)[0].collect()) == [(i, j) for i in range(n) for j in range(n) if i != j]


def test_descent_of_copies_and_codes(spark):
    x = np.repeat(curved(40), 20, axis=0)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    near, _ = descent.descend(v, 5, leaf=16)
    assert near.where("dist > 1e-12").count() == 0 and near.count() == 800 * 5
    c = hashing.codes(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(curved(1500))], "vec_id long, embedding array<double>"), 64).cache()
    near, _ = descent.descend(c, 10, "hamming", "words")
    exact = knn.knn(c, c, 10, "hamming", vector="words", with_self=False).groupBy("query_id").agg(F.max("dist").alias("far"))
    assert near.join(exact, F.col("src") == F.col("query_id")).agg(F.avg((F.col("dist") <= F.col("far")).cast("int"))).first()[0] > 0.9  # many tie


def test_index_by_descent(spark):
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(curved(1500, 3))], "vec_id long, embedding array<float>").cache()
    index = VectorIndex.build(v, descent=True)
    assert index.shards == 1 and graph.violations(v, index.edges).agg(F.sum("n")).first()[0] == 0
    assert graph.reach(v, index.edges).where("steps IS NULL").count() == 0
    exact = knn.knn(v, v, 10)
    assert graph.recall(index.search_batch(v, 50), exact, 10).first()["recall"] > 0.95


# --- reachability --------------------------------------------------------------------------------


def test_reach_and_bridges(spark):
    """Two far groups, each linked within: the second is not reached until it is bridged."""
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(60, 3)), rnd.normal(size=(60, 3)) + 100])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()
    e = graph.build_bulk(v, degree=4)
    near = {}
    for r in e.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    want, now = {0: 0}, [0]
    while now:
        now = [y for x in now for y in near[x] if y not in want and not want.update({y: want[x] + 1})]
    assert {r["vec_id"]: r["steps"] for r in graph.reach(v, e).collect()} == {i: want.get(i) for i in range(120)} and len(want) <= 60
    repaired = graph.bridged(v, e, degree=4)
    assert graph.reach(v, repaired).where("steps IS NULL").count() == 0
    assert sorted(r["rank"] for r in repaired.where("src = 5").collect()) == list(range(1, repaired.where("src = 5").count() + 1))
    assert graph.reach(v.limit(0), e).count() == 0
