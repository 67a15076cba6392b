"""Whole results at sizes where queries used to leave something out, raise, or send too much through the driver."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import shared
from nearfield.operators import graph, knn, mapped, rounds, search
from nearfield.plans import registry


def _cloud(spark, n=300, dim=6, seed=3):
    """Whole numbers: distances are exact and often tie."""
    rows = np.round(np.random.default_rng(seed).normal(size=(n, dim)) * 5)
    rows[50:60] = rows[40:50]
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("query_bytes", [32 << 20, 4000])
def test_rows_are_linked_with_the_nearest_before_them_in_all_shards(spark, tmp_path, monkeypatch, query_bytes):
    """The graph of one insertion after the other over all rows, however many shards there are."""
    v = _cloud(spark)
    v.selectExpr("*", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {(r["src"], r["rank"], r["dst"], r["dist"]) for r in graph.build_sequential(v, budget=10_000).collect()}
    monkeypatch.setattr(registry, "SHARD_ROWS", 50)
    monkeypatch.setattr(knn, "QUERY_BYTES", query_bytes)
    got = registry.QUERIES["graph_build_seq"](spark, str(tmp_path)).collect()
    assert len({r["shard"] for r in got}) == 6
    assert {(r["src"], r["rank"], r["dst"], r["dist"]) for r in got} == want and len(got) == len(want)


KINDS = [*registry.SMALL.values(), search.unbounded("cos", 9), search.bounded("ip", 5, finish=3)]


@pytest.mark.parametrize("o", KINDS)
def test_an_index_too_large_to_be_sent_is_mapped_by_all_kinds_of_searches(spark, monkeypatch, o):
    """Those with inexact sets or several probes used to raise; nothing of the index passes through the driver."""
    v = _cloud(spark).select((F.col("vec_id") * 3 + 1).alias("vec_id"), (F.expr("transform(embedding, x -> x / 7)").cast("array<float>")).alias("embedding")).cache()
    e = graph.build_bulk(v, degree=4).cache()
    q = v.where("vec_id % 31 = 1")
    found = lambda: sorted(map(tuple, search._run(q, v, e, o, "vec_id", "embedding", None, False).collect()))
    want, walks = found(), sorted(map(tuple, search.greedy_walk(q, v, e, o.metric).collect()))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    assert found() == want and len(want) > 0
    assert sorted(map(tuple, search.greedy_walk(q, v, e, o.metric).collect())) == walks


def test_mapped_edges_to_nowhere_and_vertices_without_edges(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(i, r, d) for i in [*range(15), 98] for r, d in enumerate([99, i + 1, i], 1)], "src long, rank int, dst long")
    monkeypatch.setattr(search, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(mapped, "STEP", 7)
    found = search._run(v.where("vec_id = 7"), v, e, search.unbounded("l2", 15), "vec_id", "embedding", None, False)
    assert sorted(r["vec_id"] for r in found.collect()) == list(range(15))
    assert search.greedy_walk(v, v.limit(0), e).count() == 0
    ragged = v.unionByName(spark.createDataFrame([(50, [1.0, 2.0])], v.schema))
    with pytest.raises(ValueError, match="1 to 2 components"):
        search._run(v, ragged, e, search.unbounded("l2", 15), "vec_id", "embedding", None, False)


@pytest.mark.parametrize("local", [True, False])
def test_rounds_send_nothing_that_is_exploded(spark, monkeypatch, local):
    """Rows of a table that looks small may be many once exploded: all joins of a round are merges, whatever may be sent."""
    v, plans, written = _cloud(spark), [], shared._written
    e, q = graph.build_bulk(v, degree=4).cache(), v.where("vec_id % 31 = 1")
    want = sorted(map(tuple, search.search(q, v, e, search.bounded("l2", 8)).collect()))

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, path)

    monkeypatch.setattr(shared, "_written", noted)
    if not local:
        monkeypatch.setattr(rounds, "mapped", lambda *_: None)
    assert sorted(map(tuple, search.search(q, v, e, search.bounded("l2", 8), rounds=True).collect())) == want
    joins = [x for p in plans for x in p.splitlines() if "Join" in x and "src" in x + p]
    assert any("LeftAnti" in x for x in joins) and not any("BroadcastHashJoin" in x and "_start" not in p for p in plans for x in p.splitlines())


@pytest.mark.parametrize("words", [1, 3, 8])
def test_codes_are_compared_in_words_of_64_bits(monkeypatch, words):
    """Copies and near copies, so that very many distances tie; longer words take the way of before, and the rows are the same."""
    rng, calls = np.random.default_rng(5), []
    x = rng.integers(0, 1 << 32, (900, words))
    x[300:420] = x[:120] ^ (1 << rng.integers(0, 32, (120, words)))
    x[600:640], x[700:740], x[0], x[1] = x[5], x[100:140], 0, (1 << 32) - 1
    between = knn.between
    monkeypatch.setattr(knn, "between", lambda *a: calls.append(1) or between(*a))
    monkeypatch.setattr(knn, "VECTORS", 250)
    b = lambda m: pa.RecordBatch.from_arrays([pa.array(np.arange(900)), pa.array(m.tolist(), pa.list_(pa.int64()))], names=["key", "v"])
    for m in (x, x << 8):
        (out,) = knn.nearest_in_task(SimpleNamespace(value=(np.arange(200), m[:200])), 6, "hamming", False)([b(m)])
        got = {}
        for q, v, d in sorted(zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist(), out["dist"].to_pylist(), strict=True), key=lambda r: (r[0], r[2], r[1])):
            got.setdefault(q, []).append((d, v))
        for q in range(200):
            assert got[q] == sorted((float(sum((a ^ c).bit_count() for a, c in zip(m[q].tolist(), m[v].tolist(), strict=True))), v) for v in range(900) if v != q)[:6]
        if m is x:
            assert not calls
    assert calls
