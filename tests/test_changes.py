"""Deleting, updating, compacting and filtering an index; candidates of code tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import hashing
from nearfield.operators import graph, knn, tables
from nearfield.plans.index import VectorIndex


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(6).normal(size=(600, 8))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()


def recall(index, v, asked, k=10):
    return graph.recall(index.search_batch(asked, 50), knn.knn(asked, v, k), k).first()["recall"]


@pytest.mark.parametrize("shards", [1, 3])
def test_a_fifth_is_deleted(spark, cloud, shards):
    """No deleted id is found or linked, the recall stays, and of one graph all is reached."""
    index = VectorIndex.build(cloud, shards=shards)
    asked, gone = cloud.where("vec_id % 11 = 0"), cloud.where("vec_id % 5 = 0").unionByName(spark.createDataFrame([(10**6, None), (None, None)], cloud.schema))
    left = cloud.where("vec_id % 5 <> 0")
    before, after = recall(index, cloud, asked), index.delete(gone)
    assert after.vectors.count() == 480 and graph.violations(after.vectors, after.edges).where("n > 0").count() == 0
    assert after.edges.where("src % 5 = 0 OR dst % 5 = 0").count() == 0 and after.search_batch(asked, 50).where("vec_id % 5 = 0").count() == 0
    assert recall(after, left, asked) >= before - 0.01
    if shards == 1:
        assert graph.reach(left, after.edges).where("steps IS NULL").count() == 0
    real = graph.edge_distances(after.edges.drop("dist"), left).withColumnRenamed("dist", "real")
    assert after.edges.join(real, ["src", "dst"]).where("abs(dist - real) > 1e-9").count() == 0


def test_update_and_compact(spark, cloud):
    index = VectorIndex.build(cloud, shards=1)
    moved = spark.createDataFrame([(i, [50.0 + i] * 8) for i in (3, 4, 700)], "vec_id long, embedding array<double>")
    index = index.update(moved)
    assert [r[0] for r in index.search([53.1] * 8, 2)] == [3, 4] and index.size() == (601, 8)
    index = index.add(spark.createDataFrame([(800 + i, [float(i)] * 8) for i in range(40)], "vec_id long, embedding array<double>"))
    small = index.compact(100)
    assert index.shards == 3 == small.shards and sorted(r["shard"] for r in small.vectors.select("shard").distinct().collect()) == [0, 1]
    asked = small.vectors.where("vec_id % 13 = 0")
    assert recall(small, small.vectors, asked) > 0.97 and small.edges.join(small.vectors.select(F.col("vec_id").alias("src"), F.col("shard").alias("own")), "src").where("shard <> own").count() == 0
    assert small.compact(100) is small


@pytest.mark.parametrize(("condition", "few"), [("vec_id % 100 = 7", 0.02), ("vec_id % 3 = 1", 0.02), ("vec_id % 20 = 1", 0.0), ("false", 0.02)])
def test_filters(cloud, condition, few):
    """Each query has the nearest of what is allowed: exactly where few are, nearly always where many are."""
    index, allowed, asked = VectorIndex.build(cloud, shards=2), cloud.where(condition), cloud.where("vec_id % 7 = 0")
    got = index.search_where(asked, allowed, 10, few=few)
    n = min(10, allowed.count())
    assert got.join(allowed.select("vec_id"), "vec_id").count() == got.count() == n * asked.count()
    if n:
        assert graph.recall(got, knn.knn(asked, allowed, n), n).first()["recall"] >= 0.97


def test_filters_over_codes(cloud):
    index, allowed = VectorIndex.build(cloud, "hamming", bits=64, shards=1), cloud.where("vec_id % 2 = 0")
    got = index.search_where(cloud.where("vec_id < 20"), allowed, 5)
    c = hashing.codes(cloud, 64)
    want = knn.knn(c.where("vec_id < 20"), c.where("vec_id % 2 = 0"), 5, "hamming", vector="words")
    assert graph.recall(got, want, 5).first()["recall"] > 0.9


# --- code tables ---------------------------------------------------------------------------------


def test_candidates_are_those_that_share_a_bucket(spark, monkeypatch):
    """Against plain sets; a bucket of many copies is split by salts; repeated rows, nulls and zeros."""
    monkeypatch.setattr(tables, "SALT_ROWS", 16)
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=(150, 6)), np.repeat(rnd.normal(size=(1, 6)), 80, axis=0), np.zeros((2, 6))])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, [None] * 6), (None, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    t, bits, probes = 3, 5, 3
    margin = (x @ hashing.hyperplanes(t * bits, 6).T).reshape(len(x), t, bits)
    own = [[sum(1 << j for j in range(bits) if m[j] >= 0) for m in r] for r in margin]
    looks = [[{own[i][k], *(own[i][k] ^ 1 << int(j) for j in sorted(range(bits), key=lambda j: (abs(m[j]), j))[: probes - 1])} for k, m in enumerate(r)] for i, r in enumerate(margin)]
    want = {(q, b) for q in range(len(x)) for b in range(len(x)) if any(own[b][k] in looks[q][k] for k in range(t))}
    got = [tuple(r) for r in tables.candidates(v, v, t, bits, probes).collect()]
    assert set(got) == want and len(got) == len(want)
    found = tables.search_tables(v.where("vec_id < 40"), v.where("vec_id <> 5"), 4, "cos", t, bits, probes)
    exact = knn.knn(v.where("vec_id < 40"), v.where("vec_id <> 5"), 4, "cos")
    assert graph.recall(found, exact, 4).first()["recall"] > 0.6
    with pytest.raises(ValueError):
        tables.buckets(v, 2, 63)


def test_recall_of_tables_grows_with_their_number(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(40, 16))[rnd.integers(0, 40, 1200)] + rnd.normal(size=(1200, 16)) * 0.15
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").cache()
    asked = v.where("vec_id % 10 = 0")
    exact = knn.knn(asked, v, 10)
    got = [graph.recall(tables.search_tables(asked, v, 10, tables=t, bits=8, probes=p), exact, 10).first()["recall"] for t, p in ((1, 1), (4, 3), (8, 3))]
    assert got[0] < got[1] <= got[2] and got[2] > 0.95
    assert tables.candidates(asked, v, 8, 8, 3).count() < 0.4 * asked.count() * 1200
