"""Vector and graph files: LIBSVM and dense text, raw little-endian arrays, result lines."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.shared import Scratch, number_lines, numbered
from nearfield.sources.raw import SLOTS, RawGraph, RawVectors, local_path, register

SPARSE = "array<struct<idx:int,val:float>>"


def sparse_pairs(line: Column | str, one_based: bool = True) -> Column:
    """The pairs of a LIBSVM line; the label, runs of spaces and a trailing space don't matter."""
    words = F.split(F.trim(line), r"[ \t]+")
    pairs = F.filter(words, lambda w: w.contains(":"))
    shift = 1 if one_based else 0
    return F.transform(pairs, lambda w: F.struct((F.split_part(w, F.lit(":"), F.lit(1)).cast("int") - shift).alias("idx"), F.split_part(w, F.lit(":"), F.lit(2)).cast("float").alias("val")))


def densify(pairs: Column | str, dim: int) -> Column:
    """Pairs to an array of ``dim`` floats: absent components are 0, the last of repeated ones counts, one outside raises.

    Sorted by place, each pair is put behind as many zeros as it skips: the work grows with pairs and ``dim``, not with
    their product.
    """
    pairs = F.col(pairs) if isinstance(pairs, str) else pairs
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (bound by a lambda, so that it is made once)
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))

    def filled(p: Column) -> Column:
        skipped = lambda x, i: x["idx"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(p, i - 1)["idx"]) - 1
        parts = F.transform(p, lambda x, i: F.concat(zeros(skipped(x, i)), F.array(x["val"])))
        return F.concat(F.flatten(parts), zeros(F.lit(dim - 1) - F.coalesce(F.get(p, F.size(p) - 1)["idx"], F.lit(-1))))

    def checked(s: Column) -> Column:
        last = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["idx"] != x["idx"], F.lit(True)))
        wrong = (F.get(s, F.lit(0))["idx"] < 0) | (F.get(s, F.size(s) - 1)["idx"] >= dim)
        dense = once(last, filled)
        return F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(f"component outside 0 to {dim - 1}")).cast("array<float>")).otherwise(dense)

    by_place = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["idx"].alias("idx"), i.alias("i"), p["val"].cast("float").alias("val"))))
    return F.when(pairs.isNotNull(), once(by_place, checked))


def dense_values(line: Column | str) -> Column:
    """The floats of a line; runs of spaces count once."""
    clean = F.trim(F.regexp_replace(line, r"[ \t]+", " "))
    return F.when(clean == "", F.array().cast("array<float>")).otherwise(F.split(clean, " ").cast("array<float>"))


def read_libsvm(spark: SparkSession, path: str, dim: int, one_based: bool = True) -> DataFrame:
    """(vec_id, embedding); a line's number from 0 is its id, a blank line a zero vector.

    Lines are parsed and filled batch by batch; as expressions of arrays they would be made again by every filter on them.
    """
    lines, shift = number_lines(spark.read.text(path), "vec_id"), 1 if one_based else 0

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                row, idx, val = [], [], []
                for k, line in enumerate(part.column(1).to_pylist()):
                    for word in line.split():
                        place, colon, value = word.partition(":")
                        if colon:
                            row.append(k)
                            idx.append(int(place) - shift)
                            val.append(float(value))
                i = np.array(idx, np.int64)
                if ((i < 0) | (i >= dim)).any():
                    raise ValueError(f"component outside 0 to {dim - 1}")
                flat = np.array(row, np.int64) * dim + i
                last = len(flat) - 1 - np.unique(flat[::-1], return_index=True)[1]  # of repeated components
                dense = np.zeros(part.num_rows * dim, np.float32)
                dense[flat[last]] = np.array(val)[last]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * dim, pa.int32()), pa.array(dense))], names=["vec_id", "embedding"])

    return lines.select("vec_id", "value").mapInArrow(run, "vec_id long, embedding array<float>")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    lines = number_lines(spark.read.text(path), "vec_id")
    return lines.select("vec_id", dense_values("value").alias("embedding"))


def libsvm_lines(vectors: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """(key, value): one LIBSVM line for each vector, components from 1."""
    parts = F.transform("embedding", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))
    return vectors.select(key, F.concat_ws(" ", F.col(label).cast("string"), F.array_join(parts, " ")).alias("value"))


def dense_lines(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.select(key, F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ").alias("value"))


def _write(spark: SparkSession, path: str, chunks) -> None:
    """One file on a file system that only Spark reaches: a single writer, as such files can only be written in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for c in chunks:
            out.write(bytearray(c))
    finally:
        out.close()


def _sorted_chunks(df: DataFrame, key: str):
    """Binary ``data`` in order of ``key``, about a megabyte at a time; the driver holds one partition at most."""
    held = bytearray()
    for r in df.orderBy(key).select("data").toLocalIterator():
        held += r["data"]
        if len(held) >= 1 << 20:
            yield held
            held = bytearray()
    if held:
        yield held


def _packed(df: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, kind).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["k", "data"])

    return df.select(F.col(key).cast("long"), column).mapInArrow(run, "k long, data binary").withColumnRenamed("k", key)


def _write_records(df: DataFrame, key: str, column: str, source, path: str, kind: str, **options) -> None:
    """Arrays in order of ``key`` as records; by parallel tasks where Python can open the path."""
    spark = df.sparkSession
    if not local_path(path):
        return _write(spark, path, _sorted_chunks(_packed(df, key, column, kind), key))
    register(spark)
    with Scratch(spark, "raw") as s:
        id_, values = source(options | {"path": path}).schema().replace(",", "").split()[::2]
        rows = numbered(df.select(key, column), [key], s).select(F.col("n").alias(id_), F.col(column).alias(values))
        rows.write.format(source.name()).options(**options).mode("overwrite").save(path)


def write_raw_vectors(vectors: DataFrame, path: str, key: str = "vec_id") -> None:
    """n x dim float32, row after row in order of ``key``, no header; vectors of different lengths raise."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    _write_records(vectors, key, "embedding", RawVectors, path, "<f4", dim=width)


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(first, data): records of ``size`` bytes, about a megabyte of them in a row, and the number of the first one.

    Files are split over tasks at whole records; a first job counts the records of each split.
    """
    records = spark.sparkContext.binaryRecords(path, size)
    counts = records.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    most = max(1, (1 << 20) // size)

    def chunks(part, rows):
        first = sum(counts[:part])
        while data := b"".join(islice(rows, most)):
            yield first, bytearray(data)
            first += len(data) // size

    return spark.createDataFrame(records.mapPartitionsWithIndex(chunks), "first long, data binary")


def _decoded(chunks: DataFrame, width: int, kind: str, name: str, schema: str) -> DataFrame:
    """Rows (number, array of ``width``) of chunks, decoded as whole Arrow arrays."""
    def run(batches):
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, kind)
                n = len(values) // width
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], names=["n", name])

    return chunks.mapInArrow(run, schema)


def read_raw_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(vec_id, embedding) of a file of n x dim float32."""
    if local_path(path):
        register(spark)
        return spark.read.format(RawVectors.name()).option("dim", dim).load(path)
    return _decoded(_records(spark, path, dim * 4), dim, "<f4", "embedding", "n long, embedding array<float>").withColumnRenamed("n", "vec_id")


def write_raw_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """32 ids of eight bytes for each vertex in order of vec_id: its degree, then neighbours in order of rank."""
    lists = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("to"))
    rows = vertices.select(F.col("vec_id").alias("src")).join(lists, "src", "left").withColumn("to", F.coalesce("to", F.array().cast("array<long>")))
    slots = F.concat(F.array(F.size("to").cast("long")), F.col("to"), F.array_repeat(F.lit(0).cast("long"), F.lit(SLOTS - 1) - F.size("to")))
    _write_records(rows.withColumn("slots", slots), "src", "slots", RawGraph, path, "<u8")


def read_raw_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, rank, dst) from such a file, this engine's or a user's own."""
    if local_path(path):
        register(spark)
        rows = spark.read.format(RawGraph.name()).load(path)
    else:
        rows = _decoded(_records(spark, path, SLOTS * 8), SLOTS, "<i8", "slots", "n long, slots array<long>").withColumnRenamed("n", "src")
    to = F.posexplode(F.slice("slots", 2, F.col("slots")[0].cast("int")))
    return rows.where("slots[0] > 0").select("src", to.alias("rank", "dst")).select("src", (F.col("rank") + 1).cast("int").alias("rank"), "dst")


def result_lines(results: DataFrame, display: int = 100) -> DataFrame:
    """(query_id, value): the first ids of each query, each followed by a space."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: F.concat(x["vec_id"].cast("string"), F.lit(" ")))
    return results.where(F.col("rank") <= display).groupBy("query_id").agg(F.array_join(ids, "").alias("value"))
