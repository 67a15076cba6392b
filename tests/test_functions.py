from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import bloom, distance, hashing
from nearfield.operators.visited import FORGETTING, KINDS, Listed
from nearfield.sources import vectors as files

A, B, ZERO = [1.0, 2.0, 3.0], [4.0, -5.0, 6.0], [0.0, 0.0, 0.0]


@pytest.mark.parametrize("metric,a,b,want", [("l2", A, B, 67), ("ip", A, B, -12), ("cos", A, B, -144 / 14 / 77), ("cos", A, [-x for x in B], 144 / 14 / 77), ("cos", A, ZERO, 0)])
def test_distances(spark, metric, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(distance.distance(metric, "a", "b")).first()[0] == pytest.approx(want)
    assert distance.to_rows(metric, np.array(a), np.array([b]))[0] == pytest.approx(want)
    about, off = distance.between(metric, np.array([a]), np.array([b]))
    assert distance.pairwise(metric, np.array([a]), np.array([b]))[0] == pytest.approx(want)
    assert abs(about[0, 0] - want) <= off[0] + 1e-12


def test_hamming_and_metric_names(spark):
    df = spark.createDataFrame([([0b1011], [0b0110])], "a array<long>, b array<long>")
    assert df.select(distance.hamming("a", "b")).first()[0] == 3
    with pytest.raises(ValueError):
        distance.checked("l1")


@pytest.mark.parametrize(
    "topk,words,power,hashes,p", [(1, 2, 1, 7, 0.008498), (10, 16, 4, 6, 0.022242), (50, 128, 7, 9, 0.002237), (100, 256, 8, 9, 0.002237), (500, 1024, 10, 7, 0.007576), (20000, 32768, 15, 6, 0.020212), (30000, 32768, 15, 4, 0.074201)]
)
def test_autotune(spark, topk, words, power, hashes, p):
    assert tuple(bloom.autotune(spark.createDataFrame([(topk,)], "topk long")).first()) == (topk, words, power, hashes, p)


@pytest.mark.parametrize(
    "line,want",
    [("1 1:0.5 3:-2", [0.5, 0, -2, 0]), ("7 4:1e-1 ", [0, 0, 0, np.float32(0.1)]), ("1", [0, 0, 0, 0]), ("", [0, 0, 0, 0]), ("1 2:3 2:4", [0, 4, 0, 0]), ("1  2:3   1:1", [1, 3, 0, 0])],
)
def test_libsvm_lines(spark, line, want):
    df = spark.createDataFrame([(line,)], "value string")
    assert df.select(files.densify(files.sparse_pairs("value"), 4)).first()[0] == pytest.approx(want)


def test_component_outside_raises(spark):
    df = spark.createDataFrame([("1 5:1",)], "value string")
    with pytest.raises(Exception, match="component outside"):
        df.select(files.densify(files.sparse_pairs("value"), 4)).collect()
    assert df.select(files.densify(files.sparse_pairs("value", one_based=False), 6)).first()[0][5] == 1


def test_dense_lines(spark):
    df = spark.createDataFrame([("1  2.5 -3 ",), ("",)], "value string")
    assert [r[0] for r in df.select(files.dense_values("value")).collect()] == [[1, 2.5, -3], []]


def test_codes_of_zero_vector_have_all_bits(spark):
    df = spark.createDataFrame([(0, [0.0] * 8), (1, None)], "vec_id long, embedding array<float>")
    rows = hashing.codes(df, 40).collect()
    assert [(r["vec_id"], list(r["words"])) for r in rows] == [(0, [2**32 - 1, 255])]
    assert abs(hashing.hyperplanes(64, 64).std() - 1) < 0.05


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_visited_sets_miss_nothing(kind):
    s = KINDS[kind](100)
    for x in range(0, 1500, 5):
        s.add(x)
    assert all(s.test(x) for x in range(0, 1500, 5))
    assert sum(s.test(x) for x in range(1, 1500, 5)) < 60
    if kind in FORGETTING:
        s.discard(10)
        assert not s.test(10) or kind == "cuckoo"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:0.5 2:1\n\n0 2:2\n")
    (tmp_path / "b.txt").write_text("0.5 1\n0 0\n0  2\n")
    want = [(0, [0.5, 1.0]), (1, [0.0, 0.0]), (2, [0.0, 2.0])]
    for df in (files.read_libsvm(spark, str(tmp_path / "a.txt"), 2), files.read_dense(spark, str(tmp_path / "b.txt"))):
        assert sorted((r["vec_id"], r["embedding"]) for r in df.collect()) == want


def test_result_lines(spark):
    df = spark.createDataFrame([(7, 2, 5), (7, 1, 9), (7, 3, 4)], "query_id long, rank int, vec_id long")
    assert files.result_lines(df, 2).first()["value"] == "9 5 "


def test_solvers_invert_each_other(spark):
    one, keys, rate, five = spark.range(1), F.lit(1000.0), F.lit(0.01), F.lit(5.0)
    bits = bloom.bits_needed(keys, rate, five)
    r = one.select(bits.alias("bits"), bloom.error_rate(keys, bits, five).alias("p"), bloom.room(bits, rate, five).alias("n"), bloom.bits_needed(keys, rate).alias("least")).first()
    assert r["p"] == pytest.approx(0.01, rel=0.01) and abs(r["n"] - 1000) <= 1 and r["least"] == 9586
    assert one.select(bloom.best_hashes(keys, F.lit(r["least"]))).first()[0] == 7


def test_list_is_looked_up_by_hash():
    """A full list compares a vertex with hardly any of its own, takes no more, and a vertex added twice takes two places."""

    class Counted(int):
        met = 0

        def __eq__(self, other):
            Counted.met += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    s = Listed(1000)
    for x in (0, 0, *range(1, 2000)):
        s.add(x)
    assert [x for x in map(Counted, range(2000)) if s.test(x)] == list(range(999))
    assert Counted.met < 10_000
