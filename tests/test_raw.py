"""Raw files as data sources, lines of several files, sparse lines made dense."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import hashing
from nearfield.sources import raw
from nearfield.sources import vectors as files


def test_files_are_the_raw_layout_byte_for_byte(spark, tmp_path, monkeypatch):
    """Written by several tasks, out of order and with gaps between the ids; read by several, in splits."""
    x = np.random.default_rng(2).normal(size=(700, 5)).astype("<f4")
    v = spark.createDataFrame([(7 * i + 3, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    path = f"file://{tmp_path}/v"
    files.write_raw_vectors(v, path)
    assert (tmp_path / "v").read_bytes() == x.tobytes() and os.listdir(tmp_path) == ["v"]
    monkeypatch.setattr(raw, "SPLIT_BYTES", 1000)
    raw.register(spark)
    df = spark.read.format("nearfield-vectors").option("dim", 5).load(str(tmp_path / "v"))
    assert [r["embedding"] for r in df.orderBy("vec_id").collect()] == [pytest.approx(r.tolist()) for r in x]
    assert [r["vec_id"] for r in df.select("vec_id").orderBy("vec_id").collect()] == list(range(700))
    files.write_raw_vectors(v.limit(3), path)  # takes the place of the old one
    assert os.path.getsize(tmp_path / "v") == 60
    reader = raw.RecordReader(raw.Format(str(tmp_path / "v"), 5, "<f4"), ["a", "b"])
    assert [(p.first, p.upto) for p in reader.partitions()] == [(0, 3)]


def test_graph_files(spark, tmp_path):
    near = {0: [2, 1], 1: [], 2: [0]}
    e = spark.createDataFrame([(s, r, d) for s, ds in near.items() for r, d in enumerate(ds, 1)], "src long, rank int, dst long")
    files.write_raw_graph(spark.createDataFrame([(i,) for i in near], "vec_id long"), e, str(tmp_path / "g"))
    want = np.zeros((3, 32), "<u8")
    for s, ds in near.items():
        want[s, : len(ds) + 1] = [len(ds), *ds]
    assert (tmp_path / "g").read_bytes() == want.tobytes()
    assert {tuple(r) for r in files.read_raw_graph(spark, str(tmp_path / "g")).collect()} == {(0, 1, 2), (0, 2, 1), (2, 1, 0)}


@pytest.mark.parametrize("rows", [[(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [None, 2.0])], [(0, [1.0, 2.0]), (1, None)]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    (tmp_path / "v").write_bytes(b"before")
    with pytest.raises(Exception, match="a record has 2 values"):
        files.write_raw_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), str(tmp_path / "v"))
    assert (tmp_path / "v").read_bytes() == b"before" and os.listdir(tmp_path) == ["v"]


def test_wrong_sizes_and_numbers(spark, tmp_path):
    (tmp_path / "v").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="no multiple"):
        files.read_raw_vectors(spark, str(tmp_path / "v"), 2).count()
    raw.register(spark)
    gap = spark.createDataFrame([(0, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="without gaps"):
        gap.write.format("nearfield-vectors").option("dim", 1).mode("overwrite").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="(?i)exist"):
        gap.write.format("nearfield-vectors").option("dim", 1).mode("append").save(str(tmp_path / "v"))
    assert sorted(os.listdir(tmp_path)) == ["v"]
    files.write_raw_vectors(gap.limit(0), str(tmp_path / "none"))
    assert files.read_raw_vectors(spark, str(tmp_path / "none"), 3).count() == 0


def test_paths_of_other_file_systems():
    assert raw.local_path("/a/b") == "/a/b" == raw.local_path("file:///a/b") == raw.local_path("file:/a/b") and raw.local_path("x/y:z") == "x/y:z"
    assert raw.local_path("hdfs://h/a") is None and raw.local_path("s3a://b/c") is None


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    """By file name, though Spark packs large files first; files are split as well."""
    n = 0
    for k, size in enumerate([5, 4000, 1, 900]):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"0 1:{i}\n" for i in range(n, n + size)))
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.read_libsvm(spark, str(tmp_path), 1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["vec_id"] for r in got) == list(range(n)) and all(r["embedding"] == [float(r["vec_id"])] for r in got)


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([], [0, 0, 0, 0]), ([(3, 1.5)], [0, 0, 0, 1.5]), ([(2, 1.0), (0, 2.0)], [2, 0, 1, 0]), ([(1, 1.0), (1, 2.0), (0, 9.0), (1, 3.0)], [9, 3, 0, 0]),
        ([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], [1, 2, 3, 4]), (None, None),
    ],
)
def test_densify(spark, pairs, want):
    df = spark.createDataFrame([(pairs,)], "p array<struct<idx:int,val:double>>")
    assert df.select(files.densify("p", 4)).first()[0] == want


@pytest.mark.parametrize("pairs", [[(4, 1.0)], [(-1, 1.0)], [(0, 1.0), (7, 2.0)]])
def test_densify_raises_outside(spark, pairs):
    with pytest.raises(Exception, match="component outside 0 to 3"):
        spark.createDataFrame([(pairs,)], "p array<struct<idx:int,val:float>>").select(files.densify("p", 4)).collect()


def test_codes_leave_out_null_components(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in hashing.codes(df).collect()] == [3]
    assert hashing.uint8(df.where(F.lit(False))).count() == 0
