"""Places and helpers that several modules use."""

from __future__ import annotations

import atexit
import contextlib
import logging
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels ALL to ERROR of the command line; warnings and errors go to stderr by logging's default.
LEVELS = {"ALL": logging.NOTSET, "DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARN": logging.WARNING, "ERROR": logging.ERROR}
log = logging.getLogger("nearfield")
_own: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master has a temporary folder of its own, removed at exit; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="nearfield-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, tag: str) -> str:
    """A fresh path of something that goes when the driver exits."""
    path = fresh_path(spark, tag)
    if not _tables:
        atexit.register(_drop_tables)
    _tables.append(path)
    return path


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python opens it; None if it isn't one of the file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.toUri().getPath() if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def version(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file, or of all files of a folder: another one tells that a table has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in (fs.listStatus(at) if fs.exists(at) else [])]
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again; the lineage ends there. The table goes when the driver exits."""
    return _written(df, passing_path(df.sparkSession, tag))


def _drop(path: str) -> None:
    jvm = SparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration() if SparkContext._active_spark_context else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _drop_tables() -> None:
    for path in _tables:
        with contextlib.suppress(Exception):  # the session may be gone, and with it the way to the folder
            _drop(path)


class Scratch:
    """Tables in a folder of their own under the shared one, which goes when their work is done.

    ``with Scratch(spark) as s:`` writes intermediate tables by ``s.write``; what is to stay is materialized before the end.
    """

    def __init__(self, spark: SparkSession, tag: str = "scratch"):
        self.spark, self.path, self.made, self.last = spark, fresh_path(spark, tag), 0, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.made += 1
        return _written(df, f"{self.path}/{self.made}-{tag}")

    def next(self, df: DataFrame, tag: str) -> DataFrame:
        """Write the next version of a table; the one before, from which it may be made, goes."""
        out, before = self.write(df, tag), self.last.get(tag)
        self.last[tag] = f"{self.path}/{self.made}-{tag}"
        if before:
            _drop(before)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        _drop(self.path)


def number_lines(lines: DataFrame, name: str) -> DataFrame:
    """Add dense row numbers from 0 to the lines of text files, in order of file names and of lines; no row moves.

    A first job counts the lines of each split; the counts, one for each split, are sent to all executors.
    """
    at = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    start, total = [], 0
    for r in at.groupBy("_file", "_block").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("_file", "_block").collect():
        start.append((r["_file"], r["_block"], total - r["first"]))
        total += r["n"]
    starts = lines.sparkSession.createDataFrame(start, "_file string, _block long, _start long")
    return at.join(F.broadcast(starts), ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_at", "_file", "_block", "_start")


def numbered(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Add ``n``, a row's number from 0 in ``order``; equal rows in any order.

    Rows are dealt out by Spark's own ranges and sorted there; the ranges' counts, a row for each, give where they begin.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = scratch.write(rows.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_id": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    start, total = [], 0
    for r in sorted(rows.groupBy("_part").count().collect()):
        start.append((r["_part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(start, "_part int, _start long")
    return rows.join(F.broadcast(starts), "_part").withColumn("n", F.col("_start") + F.col("_id")).drop("_part", "_id", "_start")
