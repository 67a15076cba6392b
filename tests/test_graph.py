from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.__main__ import main
from nearfield.functions import distance, hashing
from nearfield.operators import graph, knn, search
from nearfield.plans.index import VectorIndex
from nearfield.sources import vectors as files
from nearfield.streaming.search import search_stream

POINTS = [0, 10, 1, 9, 5, 2.5, 1.2]


@pytest.fixture(scope="module")
def small(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(POINTS)], "vec_id long, embedding array<double>")
    e = graph.build_sequential(v, degree=1, budget=10).cache()
    q = spark.createDataFrame([(0, [5.2])], "vec_id long, embedding array<double>")
    return v, e, q


def test_build_by_hand(small):
    _, e, _ = small
    got: dict[int, set] = {}
    for r in e.collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert got == {0: {1, 2}, 1: {0, 3}, 2: {6, 0, 5}, 3: {1}, 4: {2}, 5: {2}, 6: {2}}


def ids(df):
    return [r["vec_id"] for r in df.orderBy("rank").collect()]


def test_search_by_hand(small):
    v, e, q = small
    assert ids(knn.knn(q, v, 2)) == [4, 5]
    assert ids(search.search(q, v, e, search.unbounded("l2", 2))) == [5, 6]
    assert search.explored(q, v, e, search.unbounded("l2", 2)).first()["n_expanded"] == 4
    assert ids(search.search(q, v, e, search.bounded("l2", 2))) == [5, 6]
    assert ids(search.search(q, v, e, search.unbounded("l2", 10))) == [5, 3, 6, 2, 1, 0]
    r = search.greedy_walk(q, v, e).first()
    assert (r["vec_id"], round(r["dist"], 6), r["moves"]) == (5, 7.29, 2)
    assert {r["degree"]: r["vertices"] for r in graph.degree_histogram(v, e).collect()} == {1: 4, 2: 2, 3: 1}
    s = graph.statistics(v, e, 1).first()
    assert (s["vertices"], s["edges"], s["avg_degree"]) == (7, 11, round(11 / 7, 6))


@pytest.mark.parametrize("options", [search.Options("l2", 10, bounded=True, visited=k) for k in ("exact", "bloom", "blocked_bloom", "list")] + [search.bounded("l2", 10, visited="cuckoo"), search.bounded("l2", 10, probes=3)])
def test_all_kinds_find_the_nearest(small, options):
    v, e, q = small
    assert ids(search.search(q, v, e, options))[:2] == [5, 3]


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(3).normal(size=(400, 8))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()


def test_recall_and_invariants(spark, cloud):
    index = VectorIndex.build(cloud)
    assert all(r["n"] == 0 for r in graph.violations(cloud, index.edges).collect())
    exact = knn.knn(cloud, cloud, 10).cache()
    got = [graph.recall(index.search_batch(cloud, pq), exact, 10).first()["recall"] for pq in (10, 50, 200)]
    assert got[0] > 0.5 and got[1] > 0.9 and got[2] > 0.99


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
def test_shards_and_broadcast_agree_when_saturated(cloud, metric):
    index = VectorIndex.build(cloud, metric, shards=3)
    found = index.search_batch(cloud.limit(20), 5, search.unbounded(metric, 1000))
    exact = knn.knn(cloud.limit(20), cloud, 5, metric)
    assert graph.recall(found, exact, 5).first()["recall"] > 0.97


def test_exact_search_in_blocks(cloud, monkeypatch):
    want = {tuple(r) for r in knn.knn(cloud, cloud, 3).collect()}
    monkeypatch.setattr(knn, "QUERY_BYTES", 4000)
    monkeypatch.setattr(knn, "BLOCK_VALUES", 1000)
    assert {tuple(r) for r in knn.knn(cloud, cloud, 3).collect()} == want


def test_ties_take_the_smaller_id_and_nulls_go(spark):
    v = spark.createDataFrame([(3, [1.0]), (2, [1.0]), (1, [5.0]), (None, [1.0]), (4, None)], "vec_id long, embedding array<double>")
    assert ids(knn.knn(v.where("vec_id = 1"), v, 9)) == [1, 2, 3]
    assert knn.knn(v, v.limit(0), 2).count() == 0 and knn.knn(v.limit(0), v, 2).count() == 0


def test_save_load_add_and_metric(spark, cloud, tmp_path):
    index = VectorIndex.build(cloud.where("vec_id < 300"), "ip")
    index.save(str(tmp_path / "i"))
    back = VectorIndex.load(spark, str(tmp_path / "i")).add(cloud.where("vec_id >= 300"))
    assert back.size() == (400, 8) and back.shards == 2
    assert back.search_batch(cloud.limit(5), 5).count() == 25
    assert len(back.search([1.0] * 8, 5)) == 5
    assert back.walk(cloud.limit(5)).count() == 5
    with pytest.raises(ValueError):
        back.search_batch(cloud, 5, metric="l2")


def test_raw_files(spark, cloud, tmp_path):
    edges = graph.build_bulk(cloud)
    files.write_raw_graph(cloud, edges, str(tmp_path / "g"))
    files.write_raw_vectors(cloud, str(tmp_path / "v"))
    assert (tmp_path / "g").stat().st_size == 400 * 256 and (tmp_path / "v").stat().st_size == 400 * 32
    want = {(r["src"], r["rank"], r["dst"]) for r in edges.collect()}
    assert {tuple(r) for r in files.read_raw_graph(spark, str(tmp_path / "g")).collect()} == want
    assert files.read_raw_vectors(spark, str(tmp_path / "v"), 8).count() == 400


def test_small_cap_binds(cloud):
    edges = graph.build_bulk(cloud, degree=4)
    assert edges.groupBy("src").count().agg(F.max("count")).first()[0] == 9


def test_stream(spark, cloud, tmp_path):
    cloud.limit(30).repartition(3).write.parquet(str(tmp_path / "q"))
    out = []
    index = VectorIndex.build(cloud)
    stream = spark.readStream.schema(cloud.schema).parquet(str(tmp_path / "q"))
    search_stream(index, stream, lambda df, n: out.extend(df.collect()), 3, str(tmp_path / "c")).awaitTermination()
    assert len(out) == 90


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d").write_text("".join(f"0 1:{x}\n" for x in POINTS))
    (tmp_path / "q").write_text("0 1:5.2\n")
    assert main(["build", str(tmp_path / "d"), str(tmp_path / "i"), "1", "l2"]) == 0
    assert main(["test", str(tmp_path / "i"), str(tmp_path / "q"), "1", "l2", "5", "2"]) == 0
    assert capsys.readouterr().out == "4 5 \n"
    assert main(["tune", "100"]) == 0 and capsys.readouterr().out == "bit 256 8 hash 9 p 0.002237\n"
    assert main(["build"]) == 1 and main(["test", "a", "b", "1", "l1"]) == 1


def test_exact_search_is_the_plain_one(spark):
    """Every metric against all distances, with ties, repeated vectors, zeros and far-off values."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-3, 4, (300, 3)).astype(float)
    x[::7] *= 1e6
    x[5] = x[6] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    for metric in ("l2", "ip", "cos"):
        got = {}
        for r in knn.knn(v.where("vec_id < 40"), v, 12, metric, with_self=False).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for q in range(40):
            d = distance.to_rows(metric, x[q], x)
            want = sorted((i for i in range(300) if i != q), key=lambda i: (d[i], i))[:12]
            assert [i for _, i in sorted(got[q])] == want


def test_vectors_of_different_lengths_raise(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0]), (3, [5.0, 6.0])], "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="must have the same number"):
        knn.knn(v, v, 2).collect()
    one, two = v.where("vec_id = 2"), v.where("vec_id = 3")
    with pytest.raises(Exception, match="queries have 1 components, vectors 2"):
        knn.knn(one, two, 2).collect()
    odd = spark.createDataFrame([(1, [1.0, None]), (2, [4.0, 1.0]), (3, [float("nan"), 6.0]), (4, [float("inf"), 1.0]), (5, [4.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert [(r["query_id"], r["vec_id"]) for r in knn.knn(odd, odd, 9).orderBy("query_id", "rank").collect()] == [(2, 2), (2, 5), (5, 5), (5, 2)]


def test_large_index_by_shards_and_in_rounds(cloud, monkeypatch):
    index, asked = VectorIndex.build(cloud, shards=2), cloud.where("vec_id < 5")
    whole = graph.build_bulk(cloud)
    want = sorted(map(tuple, search.search(asked, cloud, whole, search.bounded("l2", 10)).collect()))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, search.search(asked, cloud, whole, search.bounded("l2", 10)).collect())) == want
    assert index.search_batch(asked, 5).count() == 25


def test_index_of_raw_files(spark, cloud, tmp_path, capsys):
    """A user's own pair of files, by the class and by the command line, against the same graph in tables."""
    edges = graph.build_bulk(cloud).cache()
    files.write_raw_graph(cloud, edges, str(tmp_path / "g"))
    files.write_raw_vectors(cloud, str(tmp_path / "v"))
    index = VectorIndex.from_raw(spark, str(tmp_path / "v"), str(tmp_path / "g"), 8, "ip")
    single = cloud.withColumn("embedding", F.col("embedding").cast("array<float>"))
    want = search.search(single.limit(20), single, edges, search.bounded("ip", 7), 7).collect()
    assert sorted(map(tuple, index.search_batch(single.limit(20), 7).collect())) == sorted(map(tuple, want))
    index.save(str(tmp_path / "i"))
    assert VectorIndex.load(spark, str(tmp_path / "i")).size() == (400, 8)
    (tmp_path / "q").write_text("0 0 0 0 0 0 0 1\n")
    assert main(["--log", "ERROR", "test-raw", str(tmp_path / "v"), str(tmp_path / "g"), str(tmp_path / "q"), "8", "ip", "7", "3", "--dense"]) == 0
    line = capsys.readouterr().out.split()
    assert len(line) == 3 and [int(x) for x in line] == [i for i, _ in index.search([0.0] * 7 + [1.0], 7, search.bounded("ip", 7))[:3]]


def test_index_of_codes(spark, cloud, tmp_path):
    """From vectors to codes to a search, as by exact search over the same codes."""
    index = VectorIndex.build(cloud, "hamming", bits=64, shards=2)
    coded = hashing.codes(cloud, 64)
    exact = knn.knn(coded.limit(30), coded, 5, "hamming", vector="words")
    found = index.search_batch(cloud.limit(30), 200)
    assert graph.recall(found, exact, 5).first()["recall"] > 0.95
    index.save(str(tmp_path / "i"))
    back = VectorIndex.load(spark, str(tmp_path / "i"))
    assert back.bits == 64 and back.add(cloud.withColumn("vec_id", F.col("vec_id") + 1000)).search_batch(cloud.limit(3), 4).count() == 12
    assert back.search([1.0] * 8, 5)[0][1] == int(back.search([1.0] * 8, 5)[0][1])
    with pytest.raises(ValueError):
        VectorIndex.build(cloud, "hamming")
    assert main(["build", "x"]) == 1


@pytest.mark.parametrize("metric", ["l2", "cos"])
def test_bulk_graph_by_shard(cloud, metric):
    index = VectorIndex.build(cloud, metric, shards=3, bulk=True)
    whole = VectorIndex.build(cloud, metric, bulk=True)
    assert index.shards == 3 and whole.shards == 1
    assert sorted(tuple(r)[1:4] for r in whole.edges.collect()) == sorted(tuple(r)[:3] for r in graph.build_bulk(cloud, metric).collect())
    shard = {r["vec_id"]: r["shard"] for r in index.vectors.collect()}
    assert all(shard[r["src"]] == shard[r["dst"]] == r["shard"] for r in index.edges.collect())
    exact = knn.knn(cloud.limit(20), cloud, 5, metric)
    assert graph.recall(index.search_batch(cloud.limit(20), 60), exact, 5).first()["recall"] > 0.95


def test_raw_files_of_many_splits(spark, tmp_path):
    x = np.arange(90_000 * 4, dtype="<f4").reshape(-1, 4)
    (tmp_path / "v").mkdir()
    for i in range(3):
        (tmp_path / "v" / f"part-{i}").write_bytes(x[i * 30_000 : (i + 1) * 30_000].tobytes())
    rows = files.read_raw_vectors(spark, str(tmp_path / "v"), 4)
    assert rows.count() == 90_000 and rows.where("embedding[0] <> vec_id * 4 OR size(embedding) <> 4").count() == 0


def test_line_numbers_go_on(spark, tmp_path):
    (tmp_path / "d").write_text("".join(f"{i} 1:{i}\n" for i in range(5000)))
    rows = files.read_libsvm(spark, str(tmp_path / "d"), 1)
    assert rows.count() == 5000 and rows.where("embedding[0] <> vec_id").count() == 0
