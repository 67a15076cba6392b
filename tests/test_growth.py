"""Work that must not grow with the square of the input in one task, nor pass through the driver."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import shared
from nearfield.functions import distance
from nearfield.operators import graph, knn, radius, rounds, search, tables
from nearfield.plans import registry
from nearfield.plans.index import VectorIndex


def _cloud(spark, n=300, dim=6, seed=3):
    rows = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["dist"], 9)) for r in df.collect())


@pytest.mark.parametrize("shard", [None, "shard"])
def test_room_for_all_takes_no_search_of_each_query(spark, monkeypatch, shard):
    v = _cloud(spark).withColumn("shard", F.col("vec_id").cast("int") % 3)
    edges = graph.build_sequential(v, shard="shard").where("src % 7 <> 0 AND dst % 11 <> 5")  # some can't be reached
    o, few = search.bounded("l2", 1000), v.where("vec_id < 40")
    plain = _rows(search.ranked(search._run(few, v, edges, o, "vec_id", "embedding", shard, False), 10))
    found = search._run(few, v, edges, o, "vec_id", "embedding", shard, False)
    each = found.groupBy("query_id", "shard").agg(F.count(F.lit(1)).alias("n"), F.max("n_expanded").alias("e"))
    counts = sorted(map(tuple, each.groupBy("query_id").agg(F.sum("n"), F.sum("e")).collect()))
    assert 0 < counts[0][1] < 300

    def no(*_):
        raise AssertionError("a query was searched for vertex by vertex")

    monkeypatch.setattr(search, "_run", no)
    assert _rows(search.search(few, v, edges, o, 10, shard=shard)) == plain
    assert sorted(map(tuple, search.explored(few, v, edges, o, shard=shard).collect())) == counts


def test_few_rows_are_compared_just_over_the_part_that_is_few(spark, tmp_path, monkeypatch):
    """14 of 654 rows pass, over a part of 0.02; the search of the graph is not exact."""
    _cloud(spark, 654).withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))

    def no(*_, **__):
        raise AssertionError("the graph was searched")

    monkeypatch.setattr(VectorIndex, "search_batch", no)
    found = registry.QUERIES["ann_search_where_few"](spark, str(tmp_path))
    assert found.count() == 654 * 10


def test_pairs_of_tables_are_not_written_nor_told_twice(spark, monkeypatch):
    """Each pair once without a distinct, and the nearest of the buckets without a table of pairs."""
    monkeypatch.setattr(tables, "SALT_ROWS", 16)
    monkeypatch.setattr(tables, "TURN_ROWS", 24)
    v = _cloud(spark, 400, 5).unionByName(_cloud(spark, 1, 5).select(F.explode(F.sequence(F.lit(500).cast("long"), F.lit(560).cast("long"))).alias("vec_id"), "embedding"))
    pairs = tables.candidates(v, v, 3, 4, 2)
    got = [tuple(r) for r in pairs.collect()]
    b = tables.buckets(v, 3, 4, 2)
    own = b.where("probe = 0").select(F.col("key").alias("vec_id"), "table", "bucket")
    want = b.select(F.col("key").alias("query_id"), "table", "bucket").join(own, ["table", "bucket"]).select("query_id", "vec_id").distinct()
    assert len(got) == len(set(got)) and set(got) == set(map(tuple, want.collect()))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "query_id" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)
    monkeypatch.setattr(tables, "candidates", None)
    x, y = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), v.select("vec_id", F.col("embedding").alias("b"))
    exact = search.ranked(want.join(x, "query_id").join(y, "vec_id").select("query_id", "vec_id", distance.l2("a", "b").alias("dist")), 5)
    assert _rows(tables.search_tables(v, v, 5, "l2", 3, 4, 2)) == _rows(exact)


def test_many_queries_do_not_pass_through_the_driver(spark, monkeypatch):
    v = _cloud(spark, 500)
    want = _rows(knn.knn(v, v, 7, with_self=False))
    monkeypatch.setattr(knn, "QUERY_BYTES", 8000)

    def no(*_):
        raise AssertionError("queries were sent")

    monkeypatch.setattr(knn, "query_batches", no)
    assert _rows(knn.knn(v, v, 7, with_self=False)) == want


def test_later_vectors_that_are_all_nearer(spark, monkeypatch):
    """Where a block has a crowd within the bound of the blocks before."""
    monkeypatch.setattr(knn, "VECTORS", 50)
    x = np.array([[1000.0 - i, 0.0] for i in range(400)])
    sent = SimpleNamespace(value=(np.arange(3), x[-3:]))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), pa.array(x.tolist())], names=["key", "v"])
    (out,) = knn.nearest_in_task(sent, 2, "l2", True)([b])
    assert out["vec_id"].to_pylist() == [397, 396, 398, 397, 399, 398]


def test_insertion_in_more_shards_where_there_are_more_rows(spark, tmp_path, monkeypatch):
    """And no query builds one graph of all rows vertex by vertex."""
    _cloud(spark, 300).withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(registry, "SHARD_ROWS", 50)

    def no(*_):
        raise AssertionError("one task has built the whole graph")

    monkeypatch.setattr(registry, "_sequential", no)
    edges = registry.QUERIES["graph_build_seq"](spark, str(tmp_path))
    assert edges.select("shard").distinct().count() == 6
    assert {r["n"] for r in registry.QUERIES["graph_build_seq_violations"](spark, str(tmp_path)).collect()} == {0}
    assert registry.QUERIES["ann_search_small_cuckoo"](spark, str(tmp_path)).count() == 3000


def test_rounds_do_not_send_what_queries_have_visited(spark, monkeypatch):
    v, plans = _cloud(spark, 60), []
    written = shared._written

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, path)

    monkeypatch.setattr(shared, "_written", noted)
    edges, o = graph.build_bulk(v, degree=4), search.bounded("l2", 8)
    few = v.where("vec_id < 5")
    got = _rows(search.search(few, v, edges, o, 5, rounds=True))
    anti = [x for p in plans for x in p.splitlines() if "LeftAnti" in x]
    assert anti and not any("BroadcastHashJoin" in x for x in anti)
    assert got == _rows(search.search(few, v, edges, o, 5))


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
@pytest.mark.parametrize("with_self", [True, False])
def test_blocks_are_compared_in_single_precision_and_the_rows_stay_exact(monkeypatch, metric, with_self):
    """Near copies that single precision can't tell apart, zeros, repeated ids and lengths of many magnitudes; the double
    way is for what single precision says nothing of."""
    rng, calls = np.random.default_rng(5), []
    x = np.concatenate((rng.normal(size=(600, 7)), rng.normal(size=(90, 7)) * 1e-9 + 3, np.zeros((5, 7)), rng.normal(size=(200, 7)) * 10.0 ** rng.integers(-6, 7, (200, 1))))
    ids = rng.integers(0, 800, len(x))
    b = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist())], names=["key", "v"])
    monkeypatch.setattr(knn, "FIRST", 32)
    between = knn.between
    monkeypatch.setattr(knn, "between", lambda *a: calls.append(len(a[1]) * len(a[2])) or between(*a))
    keys, q = np.arange(300), x[500:800]
    (out,) = knn.nearest_in_task(SimpleNamespace(value=(keys, q)), 6, metric, with_self)([b])
    got = sorted(zip(*(c.to_pylist() for c in out.columns), strict=True), key=lambda r: (r[0], r[2], r[1]))
    want = []
    for key, row in zip(keys.tolist(), q, strict=True):
        d = distance.pairwise(metric, np.repeat(row[None], len(x), 0), x)
        want += sorted(((key, i, e) for i, e in zip(ids.tolist(), d.tolist(), strict=True) if with_self or i != key), key=lambda r: (r[2], r[1]))[:6]
    assert got == want
    calls.clear()
    (out,) = knn.nearest_in_task(SimpleNamespace(value=(keys, x[:300])), 6, metric, with_self)([b.slice(0, 600)])
    assert len(out) == 1800 and not calls


def test_reach_makes_its_edges_once(spark):
    """Rounds read what the first one wrote: an edge table that counts its rows is read once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long").mapInArrow(count, "src long, dst long")
    v = spark.range(7).withColumnRenamed("id", "vec_id")
    assert {r["vec_id"]: r["steps"] for r in graph.reach(v, edges).collect()} == {i: i for i in range(7)}
    assert seen.value == 6


def test_walks_at_one_vertex_are_dealt_out(spark, monkeypatch):
    """All start at one: no join has all of them, with their vectors, for a single key."""
    v, plans = _cloud(spark, 200), []
    edges = graph.build_bulk(v, degree=4)
    rows = lambda df: sorted((r["query_id"], r["vec_id"], round(r["dist"], 9), r["moves"]) for r in df.collect())
    want = rows(search.greedy_walk(v, v, edges))
    written = shared._written

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, path)

    monkeypatch.setattr(shared, "_written", noted)
    monkeypatch.setattr(rounds, "WALKS", 16, raising=False)
    assert rows(search.greedy_walk(v, v, edges, rounds=True)) == want
    assert any("turn" in x for p in plans for x in p.splitlines() if "Join" in x)


def test_pairs_of_a_dense_ball_are_gathered_in_part(monkeypatch):
    """All vectors are within the radius of each other: their vectors are not all gathered at once."""
    x, most = np.random.default_rng(3).normal(size=(700, 5)) * 1e-3, [0]
    pairwise = radius.pairwise
    monkeypatch.setattr(radius, "pairwise", lambda m, a, b: most.append(len(a)) or pairwise(m, a, b))
    none = np.zeros(700, np.int64)
    columns = [*(pa.array(none) for _ in range(4)), pa.array(none.astype(bool)), pa.array(np.arange(700)), pa.array(x.tolist())]
    b = pa.RecordBatch.from_arrays(columns, names=["cell", "ring", "block", "turn", "visitor", "class_id", "v"])
    got = [tuple(r) for o in radius._compare(1.0)([b]) for r in zip(o["vec_id"].to_pylist(), o["other_id"].to_pylist(), strict=True)]
    assert len(got) == len(set(got)) == 700 * 699 // 2 and all(i < j for i, j in got)
    assert max(most) <= 1 << 16


def test_parts_are_sent_as_floats(spark, monkeypatch):
    """Queries and vectors in parts are sent in the type they were given in, no oftener than tasks ask for; the rows are the same."""
    from nearfield.operators import knn

    rnd = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(600, 8)))], "vec_id long, embedding array<float>").cache()
    want, sent, whole = sorted(map(tuple, knn.knn(v, v, 5).collect())), [], knn._in_parts
    monkeypatch.setattr(knn, "_in_parts", lambda *a: sent.append(a[:2]) or whole(*a))
    monkeypatch.setattr(knn, "QUERY_BYTES", 24_000)
    found = knn.knn(v, v, 5)
    assert sorted(map(tuple, found.collect())) == want
    assert [x.schema["v"].dataType.simpleString() for x in sent[0]] == ["array<float>"] * 2


def test_descent_sends_only_what_may_bring_news(spark, monkeypatch):
    """Vectors go out in the type they were given in, and only to vertices that have somebody new."""
    from nearfield.operators import descent

    rnd = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(400, 6)))], "vec_id long, embedding array<float>").cache()
    offers, kinds, idle = descent._offers, set(), []

    def seen(members, *more):
        kinds.add(members.schema["v"].dataType.simpleString())
        idle.append(members.groupBy("u").agg(F.max("fresh").alias("some")).where("NOT some").count())
        return offers(members, *more)

    monkeypatch.setattr(descent, "_offers", seen)
    _, about = descent.descend(v, 5, leaf=16, trees=2)
    assert about["rounds"] > 2 and kinds == {"array<float>"} and not any(idle)
