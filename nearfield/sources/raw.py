"""Files of records of one size as Spark data sources: ``nearfield-vectors`` and ``nearfield-graph``.

A file has record after record and no header; a record's number is its id. Reading is split at records; each task reads
its own bytes. Rows to write come with their numbers, so each task writes its records where they belong, into a file
that takes the real name when all tasks are done, and goes if one of them fails. A task that runs twice writes the same
bytes. The file system must be one that Python opens by path, shared by driver and executors.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Slots of a vertex in a raw graph: its degree and up to 31 neighbours.
SLOTS = 32
#: Bytes that a task reads, and of a batch of it.
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 1 << 20


def local_path(path: str) -> str | None:
    """The path as Python opens it; None for one of another file system."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return ("/" + rest.lstrip("/")) if scheme == "file" else None


@dataclass
class Format:
    path: str
    width: int
    kind: str  # of a value in the file

    @property
    def size(self) -> int:
        return self.width * np.dtype(self.kind).itemsize


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``upto`` of all, of which ``path`` has those from ``start`` on."""

    first: int
    upto: int
    path: str = ""
    start: int = 0


@dataclass
class Written(WriterCommitMessage):
    records: int
    upto: int


class RecordReader(DataSourceReader):
    def __init__(self, form: Format, names: list[str]):
        self.form, self.names = form, names

    def partitions(self) -> list[Range]:
        """Of the file, or of a folder's files in order of name, each of whole records."""
        at, size = self.form.path, self.form.size
        files = [os.path.join(at, f) for f in sorted(os.listdir(at)) if f[0] not in "._"] if os.path.isdir(at) else [at]
        out, start, step = [], 0, max(1, SPLIT_BYTES // size)
        for path in files:
            total = os.path.getsize(path)
            if total % size:
                raise ValueError(f"{path} has {total} bytes, no multiple of records of {size}")
            upto = start + total // size
            out += [Range(i, min(i + step, upto), path, start) for i in range(start, upto, step)]
            start = upto
        return out or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        form, step = self.form, max(1, BATCH_BYTES // self.form.size)
        if partition.first == partition.upto:
            return
        with open(partition.path, "rb") as f:
            f.seek((partition.first - partition.start) * form.size)
            for first in range(partition.first, partition.upto, step):
                n = min(step, partition.upto - first)
                values = np.frombuffer(f.read(n * form.size), form.kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * form.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], names=self.names)


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, form: Format, overwrite: bool):
        if not overwrite and os.path.exists(form.path):
            raise FileExistsError(form.path)
        self.form, self.part = form, f"{form.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        form, records, upto = self.form, 0, 0
        f = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                n, lists = b.column(0).to_numpy(), b.column(1)
                if lists.null_count or (np.diff(lists.offsets.to_numpy()) != form.width).any() or lists.flatten().null_count:
                    raise ValueError(f"a record has {form.width} values, none of them null")
                data = lists.flatten().to_numpy(zero_copy_only=False).astype(form.kind).tobytes()
                cut = [0, *(np.flatnonzero(np.diff(n) != 1) + 1).tolist(), len(n)]
                for a, z in zip(cut[:-1], cut[1:], strict=True):  # records in a row at once
                    part, at = memoryview(data)[a * form.size : z * form.size], int(n[a]) * form.size
                    while part:
                        done = os.pwrite(f, part, at)
                        part, at = part[done:], at + done
                records, upto = records + len(n), max(upto, int(n.max()) + 1)
        finally:
            os.close(f)
        return Written(records, upto)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        if sum(m.records for m in done) != max((m.upto for m in done), default=0):
            self.abort(messages)
            raise ValueError("records must be numbered from 0 without gaps")
        if not os.path.exists(self.part):
            open(self.part, "wb").close()
        os.replace(self.part, self.form.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class RawVectors(DataSource):
    """(vec_id, embedding): float32, ``dim`` of them a vector (an option)."""

    @classmethod
    def name(cls) -> str:
        return "nearfield-vectors"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def _format(self) -> Format:
        return Format(local_path(self.options["path"]), int(self.options["dim"]), "<f4")

    def reader(self, schema) -> RecordReader:
        return RecordReader(self._format(), ["vec_id", "embedding"])

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self._format(), overwrite)


class RawGraph(RawVectors):
    """(src, slots): 32 ids of eight bytes, a degree and so many neighbours first."""

    @classmethod
    def name(cls) -> str:
        return "nearfield-graph"

    def schema(self) -> str:
        return "src long, slots array<long>"

    def _format(self) -> Format:
        return Format(local_path(self.options["path"]), SLOTS, "<i8")

    def reader(self, schema) -> RecordReader:
        return RecordReader(self._format(), ["src", "slots"])


def register(spark: SparkSession) -> None:
    for source in (RawVectors, RawGraph):
        spark.dataSource.register(source)
