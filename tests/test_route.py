"""Shards by centroids: sizes, recall against shards visited."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import graph, knn, route, search
from nearfield.plans.index import VectorIndex


@pytest.fixture(scope="module")
def groups(spark):
    rnd = np.random.default_rng(3)
    x = (rnd.normal(size=(12, 8)) * 3)[np.minimum(rnd.integers(0, 18, 1500), 11)] + rnd.normal(size=(1500, 8))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, [None] * 8)], "vec_id long, embedding array<float>").cache()


def test_few_shards_find_nearly_all(spark, groups):
    """Recall grows with the centroids visited and is that of all shards when all are; no shard is over its size."""
    dealt, routes = route.deal(groups, 10, 150)
    dealt = dealt.cache()
    size = {r["shard"]: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert sum(size.values()) == 1500 and max(size.values()) <= 150 and set(size) == set(range(routes.count.sum())) and routes.count.max() > 1
    edges = graph.build_sequential(dealt, budget=60, shard="shard").cache()
    asked, o = groups.where("vec_id % 15 = 0"), search.bounded("l2", 40)
    exact = knn.knn(asked, groups, 10)
    got = [graph.recall(route.search_routed(asked, dealt, edges, routes, o, visit, 10), exact, 10).first()["recall"] for visit in (1, 3, 10)]
    assert got[0] < got[1] <= got[2] and got[1] > 0.95 and got[2] > 0.99
    every = search.search(asked, dealt, edges, o, 10, shard="shard")
    assert sorted(map(tuple, route.search_routed(asked, dealt, edges, routes, o, 10, 10).collect())) == sorted(map(tuple, every.collect()))


def test_routed_index(spark, groups):
    index = VectorIndex.routed(groups, 10, 200, budget=60)
    asked = groups.where("vec_id % 50 = 0")
    exact = knn.knn(asked, groups, 10)
    assert graph.recall(index.search_batch(asked, 40, visit=4), exact, 10).first()["recall"] > 0.95
    assert index.shards > 10 and index.size()[0] == 1500
    with pytest.raises(ValueError):
        index.add(asked.withColumn("vec_id", F.col("vec_id") + 10**6)).search_batch(asked, 40, visit=4)


def test_copies_and_few_rows(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    dealt, routes = route.deal(v, 4, 50, "cos")
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] <= 50
    few, routes = route.deal(v.limit(2), 8, 50)
    assert few.count() == 2 and len(routes.centroids) == 2
    none, routes = route.deal(v.limit(0), 3, 50)
    assert none.count() == 0
    with pytest.raises(ValueError):
        route.deal(v, 3, 50, "hamming")


def test_each_shard_is_searched_once(spark, groups, monkeypatch):
    """A search of eight centroids holds those of fewer; queries that meet a shard in turns find the same."""
    dealt, routes = route.deal(groups, 10, 150)
    edges = graph.build_sequential(dealt, budget=60, shard="shard").cache()
    asked, o = groups.where("vec_id % 15 = 0"), search.bounded("l2", 40)
    monkeypatch.setattr(route, "TURN", 9)
    found = route.found_routed(asked, dealt, edges, routes, o, 8, 10).cache()
    monkeypatch.undo()
    for visit in (1, 2, 8):
        want = route.search_routed(asked, dealt, edges, routes, o, visit, 10)
        assert sorted(map(tuple, knn.ranked(found.where(F.col("nth") <= visit), 10).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("metric", ["l2", "hamming", "ip"])
def test_searches_abreast_are_those_of_one_query(metric):
    """Ids, distances to the last bit and counts; with ties, repeated edges and vertices that nothing reaches."""
    rnd = np.random.default_rng(5)
    for n, degree in ((1, 0), (60, 3), (400, 12)):
        v = rnd.integers(0, 3, (n, 4)).astype(np.int64 if metric == "hamming" else float)
        v = v if metric == "hamming" or n == 60 else v + rnd.normal(size=v.shape)
        ends = rnd.integers(0, n, (2, n * degree)) * 3 + 1
        g = search.Graph.of(np.arange(n) * 3 + 1, v, ends[0], np.arange(n * degree), ends[1])
        for pq in (1, 2, 50, 500):
            o, q = search.bounded(metric, pq), v[rnd.integers(0, n, 300)]
            for (i, d, e), (ids, dist, expanded) in zip(g.search_all(q, o), map(lambda x: g.search(x, o), q), strict=True):
                assert i.tolist() == ids.tolist() and d.tolist() == dist.tolist() and e == expanded
    odd = v.astype(float)
    odd[3] = np.nan
    g = search.Graph.of(np.arange(n), odd, rnd.integers(0, n, 900), np.arange(900), rnd.integers(0, n, 900))
    if metric != "hamming":
        assert [x[0].tolist() for x in g.search_all(odd[:20], search.bounded(metric, 9))] == [g.search(x, search.bounded(metric, 9))[0].tolist() for x in odd[:20]]
