"""Random-hyperplane codes whose normals any engine can compute with 64-bit integers.

With m = 2^31 - 1 and x = 12 * (bit * dim + component) + t + 1 for t from 0 to 11: h1 = 48271 x mod m,
h2 = (h1^2 + 16807 x) mod m, h3 = (h2^2 + h1) mod m; a weight is the sum of the twelve h3 / m, less 6: about normal.
A bit is set where the projection is not negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M = 2147483647


def hyperplanes(bits: int, dim: int) -> np.ndarray:
    x = (np.arange(bits * dim, dtype=np.int64)[:, None] * 12 + np.arange(12) + 1).astype(np.int64)
    h1 = 48271 * x % M
    h2 = (h1 * h1 + 16807 * x) % M
    h3 = (h2 * h2 + h1) % M
    w = np.zeros(bits * dim)
    for t in range(12):
        w += h3[:, t] / M
    return (w - 6.0).reshape(bits, dim)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 to rows of 32-bit words, lowest bit first."""
    n, k = bits.shape
    full = np.zeros((n, -(-k // 32) * 32), np.int64)
    full[:, :k] = bits
    return (full.reshape(n, -1, 32) << np.arange(32)).sum(2)


def codes(vectors: DataFrame, bits: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, words array<long>): one matrix product for each Arrow batch; rows without a vector, or with a null component, have no code."""

    def run(batches):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            if planes is None:
                planes = hyperplanes(bits, x.shape[1])
            words = pack((x @ planes.T >= 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(words), pa.list_(pa.int64()))], names=["key", "words"])

    rows = vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"key {vectors.schema[key].dataType.simpleString()}, words array<long>").withColumnRenamed("key", key)


def as_bits(coded: DataFrame, bits: int, key: str = "vec_id") -> DataFrame:
    """(key, bit, value) rows of packed words."""
    at = coded.select(key, F.posexplode("words").alias("word", "bits"))
    one = at.select(key, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    out = one.select(key, (F.col("word") * 32 + F.col("i")).cast("int").alias("bit"), F.expr("cast(shiftright(bits, i) & 1 as int)").alias("value"))
    return out.where(F.col("bit") < bits)


def as_words(coded: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, word, bits) rows."""
    return coded.select(key, F.posexplode("words").alias("word", "bits"))


def uint8(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, code int): the first eight planes in one byte."""
    return codes(vectors, 8, key, vector).select(key, F.col("words")[0].cast("int").alias("code"))
