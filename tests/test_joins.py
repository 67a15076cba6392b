"""As-of and radius joins against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import radius
from nearfield.operators.asof import asof_join

LEFT, RIGHT = "k int, t int, name string", "k int, t int, name string, n int"


def plain_asof(left, right, strict=False, forward=False, tolerance=None):
    out = []
    for k, t, name in left:
        ok = [r for r in right if None not in (k, t, r[1]) and r[0] == k and (r[1] >= t if forward else r[1] <= t)]
        ok = [r for r in ok if not (strict and r[1] == t) and (tolerance is None or abs(r[1] - t) <= tolerance)]
        best = max(ok, key=lambda r: (-r[1] if forward else r[1], r[3]), default=(None,) * 4)
        out.append((k, t, name, best[1], best[2], best[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_with_a_hot_key_over_many_ranges(spark, strict, forward, tolerance):
    rnd = random.Random(5)
    key = lambda: rnd.choice([1, 1, 1, 2, 3, 4, None])
    time = lambda: rnd.choice([None, *range(60)])
    left = [(key(), time(), f"l{i % 40}") for i in range(200)]
    right = [(key(), time(), f"r{i}", i) for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "n", strict, forward, tolerance)
        assert got.columns == ["k", "t", "name", "t_right", "name_right", "n"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_asof(left, right, strict, forward, tolerance)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_of_empty_tables_and_of_no_key(spark):
    left, none = spark.createDataFrame([(1, 5, "a"), (2, 7, "b")], LEFT), spark.createDataFrame([], RIGHT)
    assert sorted(map(tuple, asof_join(left, none, ["k"], "t").collect())) == [(1, 5, "a", None, None, None), (2, 7, "b", None, None, None)]
    assert asof_join(left.limit(0), none, ["k"], "t").count() == 0
    right = spark.createDataFrame([(9, 6, "r", 0)], RIGHT).drop("k")
    assert sorted(map(tuple, asof_join(left, right, [], "t").collect())) == [(1, 5, "a", None, None, None), (2, 7, "b", 6, "r", 0)]


def test_asof_tolerance_of_times_and_clashing_names(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at)], "k int, t timestamp")
    right = spark.createDataFrame([(1, at - timedelta(hours=5))], "k int, t timestamp")
    assert asof_join(left, right, ["k"], "t", tolerance=F.expr("INTERVAL 5 HOURS")).first()["t_right"] == at - timedelta(hours=5)
    assert asof_join(left, right, ["k"], "t", tolerance=F.expr("INTERVAL 4 HOURS")).first()["t_right"] is None
    with pytest.raises(ValueError, match="twice"):
        asof_join(left.withColumn("t_right", F.lit(1)), right, ["k"], "t")


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 16), ("VISITORS", 32), ("ROWS", 7)):
        monkeypatch.setattr(radius, name, value)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("r", [0.0, 0.4, 3.0])
def test_radius_join_same_as_all_pairs(spark, small_blocks, r):
    g = np.random.default_rng(3)
    # A bent plane, three vectors of fifty copies each, a dense heap far smaller than the radius.
    x = np.concatenate([g.normal(size=(300, 2)) @ g.normal(size=(2, 8)), np.repeat(g.normal(size=(3, 8)), 50, 0), g.normal(size=(90, 8)) * 0.01])
    found = radius.within(frame(spark, x), r)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = (d <= r * r).sum(1) - 1
    members = {m["vec_id"]: m["class_id"] for m in found.members.collect()}
    assert members == {i: int(np.flatnonzero((x == x[i]).all(1))[0]) for i in range(len(x))}
    pairs = [(p["vec_id"], p["other_id"]) for p in found.pairs.collect()]
    own = sorted(set(members.values()))
    assert sorted(pairs) == [(i, j) for i in own for j in own if i < j and d[i, j] <= r * r]
    assert {m["vec_id"]: m["n_links"] for m in found.links().collect()} == dict(enumerate(want.tolist()))


def test_radius_join_compares_few_pairs_of_vectors_with_structure(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(5000, 2)) @ g.normal(size=(2, 16))
    found = radius.within(frame(spark, x), 0.05)
    assert found.compared < 0.1 * 5000 * 4999 / 2
    d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    assert found.pairs.count() == np.count_nonzero(np.triu(d <= 0.05**2, 1))


def test_radius_join_of_odd_rows(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, None), (None, [0.0, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, [0.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    found = radius.within(df, 0.5)
    assert sorted(map(tuple, found.links().collect())) == [(1, 1, 2), (2, 1, 2), (7, 7, 2)]
    assert [tuple(p) for p in found.pairs.collect()] == [(1, 7, 0.25)]
    none = radius.within(df.limit(0), 1.0)
    assert none.pairs.count() == none.members.count() == none.links().count() == none.compared == 0
    assert radius.within(frame(spark, np.zeros((40, 3))), 1.0).links().agg(F.min("n_links"), F.max("class_id")).first()[:] == (39, 0)
    with pytest.raises(Exception, match="components"):
        radius.within(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), 1.0).pairs.count()
    with pytest.raises(ValueError, match="radius"):
        radius.within(df, -1.0)


def test_pivots_are_many_where_they_rule_cells_out_and_few_where_not(spark):
    g = np.random.default_rng(6)
    plane = g.normal(size=(1200, 2)) @ g.normal(size=(2, 16))
    loose = g.normal(size=(1200, 64))
    loose /= np.linalg.norm(loose, axis=1)[:, None]
    assert radius._pivots(plane[:200], plane[200:], 40_000, 0.05) >= 50
    assert radius._pivots(loose[:200], loose[200:], 40_000, 1.1) <= 3
