"""An index of any size as arrays in files of the shared folder, which tasks map into memory.

Ids in ascending order, their vectors in the type they were given in, and neighbours as places. Tasks write the files, each
its own rows; nothing of the index passes through the driver, and the tasks of a machine share the pages that they read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.shared import Scratch, local_path, numbered, passing_path

#: Vertices whose lists' lengths the driver adds up at a time, and components up to which distances are finite.
STEP, FINITE = 1 << 20, 1e60
KINDS = {"float": np.float32, "double": np.float64, "bigint": np.int64}


class Rows:
    """Vectors in a file, as numbers of the type that distances are computed in. ``small``: whether all distances are finite."""

    def __init__(self, m: np.ndarray, small: bool):
        self.m, self.small, self.kind = m, small, np.int64 if m.dtype == np.int64 else np.float64

    def __len__(self) -> int:
        return len(self.m)

    def __getitem__(self, at) -> np.ndarray:
        return self.m[at].astype(self.kind)


@dataclass(frozen=True)
class Mapped:
    path: str
    small: bool

    def open(self, name: str, mode: str = "r") -> np.ndarray:
        m = np.load(f"{self.path}/{name}.npy", mmap_mode=mode)
        return m if mode != "r" else m.view(np.ndarray)

    def rows(self) -> tuple[np.ndarray, Rows]:
        """Ids and vectors."""
        return self.open("ids"), Rows(self.open("vectors"), self.small)

    def arrays(self) -> tuple[np.ndarray, Rows, np.ndarray, np.ndarray]:
        """Ids, vectors, where the neighbours of each start, and the neighbours."""
        return *self.rows(), self.open("start"), self.open("to")


def _made(path: str, name: str, kind, shape) -> None:
    np.lib.format.open_memmap(f"{path}/{name}.npy", "w+", kind, shape).flush()


def _each(df: DataFrame, write) -> list:
    """Run ``write(batch)`` on all batches; what it returns."""

    def run(batches):
        out = [bool(write(b)) for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([all(out)])], names=["ok"])

    return [r["ok"] for r in df.mapInArrow(run, "ok boolean").collect()]


def _places(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids, and whether they are there."""
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return at, ids[at] == x


def mapped(vectors: DataFrame, edges: DataFrame | None = None) -> Mapped | None:
    """Prepared vectors (key, v) and edges (src, rank, dst) as files; None where there is no vector or the shared folder is no
    path of the file system. Edges from or to what is no vector are none."""
    spark = vectors.sparkSession
    path = local_path(spark, passing_path(spark, "mapped"))
    if path is None:
        return None
    with Scratch(spark, "mapping") as s:
        rows = numbered(vectors.select("key", "v"), ["key"], s)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        n, dim = size["n"], size["most"]
        if not n:
            return None
        if size["least"] != dim:
            raise ValueError(f"vectors have {size['least']} to {dim} components; all must have the same number")
        os.makedirs(path)
        kind = KINDS[vectors.schema["v"].dataType.elementType.simpleString()]
        _made(path, "ids", np.int64, (n,))
        _made(path, "vectors", kind, (n, dim))
        own = Mapped(path, True)

        def put(b):
            at, m = b.column(0).to_numpy(), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)
            own.open("ids", "r+")[at] = b.column(1).to_numpy()
            own.open("vectors", "r+")[at] = m
            return not m.size or max(m.max(), -m.min()) < FINITE  # false for what is no number

        own = Mapped(path, all(_each(rows.select("n", "key", "v"), put)))
        if edges is None:
            return own
        _made(path, "start", np.int64, (n + 1,))

        def placed(batches):
            ids, degree = own.open("ids"), own.open("start", "r+")
            for b in batches:
                if not b.num_rows:
                    continue
                at, there = _places(ids, b.column(0).to_numpy())
                to, known = _places(ids, b.column(1).flatten().to_numpy())
                of = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
                known &= there[of]
                count = np.bincount(of[known], minlength=b.num_rows)
                degree[at[there] + 1] = count[there]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[there]))), pa.int32()), pa.array(to[known], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(at[there]), lists], names=["at", "to"])

        ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"])
        lists = s.write(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(ranked.alias("to")).mapInArrow(placed, "at long, to array<long>"), "lists")
        start, total = own.open("start", "r+"), 0
        for i in range(0, n + 1, STEP):
            start[i : i + STEP] = total + np.cumsum(start[i : i + STEP])
            total = int(start[min(i + STEP, n + 1) - 1])
        start.flush()
        _made(path, "to", np.int32 if n < 1 << 31 else np.int64, (max(1, total),))

        def link(b):
            start, to = own.open("start"), own.open("to", "r+")
            count = np.diff(b.column(1).offsets.to_numpy())
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            to[np.repeat(start[b.column(0).to_numpy()], count) + nth] = b.column(1).flatten().to_numpy()
            return True

        _each(lists, link)
    return own
