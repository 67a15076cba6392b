"""What the operators share: tables, the shared folder, Arrow mapping and word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.shared import Scratch, materialize  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds the per-task function once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes, null as empty; no copy through Python strings."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


# --- words ---------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240)).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_pow: dict[int, np.ndarray] = {}


def _power(n: int, base: int) -> np.ndarray:
    if base not in _pow or len(_pow[base]) < n:
        _pow[base] = _powers(1 << max(16, (n - 1).bit_length()), base)
    return _pow[base][:n]


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space, A-Z as a-z) and how many each text has.

    Polynomial sums over the joined bytes; works through whole texts in blocks of about ``chunk`` bytes cut between texts.
    """
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < chunk):
            size += len(texts[j]) + 1
            j += 1
        b = np.frombuffer(b" ".join([*texts[i:j], b""]), np.uint8)
        gap = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * _power(len(b), _ODD), dtype=np.uint64)))
        hashes.append(mix((total[end] - total[start]) * _power(len(b) + 1, _INV)[start] + (end - start).astype(np.uint64)))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts[i:j] = np.diff(np.searchsorted(start, ends), prepend=0)
        i = j
    return np.concatenate(hashes), counts


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``words``-word shingles; of a shorter text, its whole sequence as one."""
    h, counts = word_hashes(texts)
    n = len(h)
    roll = h.copy()
    for k in range(1, words):
        roll[: n - k] = mix(roll[: n - k] * np.uint64(_ODD) + h[k:])
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            s = np.sort(roll[at : at + c - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            x = h[at : at + 1].copy()
            for k in range(1, c):
                x = mix(x * np.uint64(_ODD) + h[at + k])
            out.append(mix(x + np.uint64(c)))
        else:
            out.append(h[:0])
        at += c
    return out
