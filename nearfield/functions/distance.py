"""Distances as Spark columns and as numpy kernels. Smaller is nearer for every metric.

l2 is squared; ip is the negative inner product; cos is -c * |c| with c the cosine, and 0 for a zero vector; hamming
counts differing bits of 32-bit words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cos", "hamming")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm2(v: Column | str) -> Column:
    """Squared norm."""
    return _sum(F.transform(_doubles(v), lambda x: x * x))


def l2(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def ip(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def cos(a: Column | str, b: Column | str) -> Column:
    s, n = dot(a, b), norm2(a) * norm2(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(-s * F.abs(s) / n)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Of arrays of words."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, v: s + v)


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return {"l2": l2, "ip": ip, "cos": cos, "hamming": hamming}[checked(metric)](a, b)


def checked(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}, not {metric!r}")
    return metric


def to_rows(metric: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of one vector to the rows of a matrix."""
    if metric == "l2":
        d = m - q
        return np.einsum("ij,ij->i", d, d)
    if metric == "hamming":
        return np.bitwise_count(m ^ q).sum(1).astype(np.float64)
    s = m @ q
    if metric == "ip":
        return -s
    n = np.einsum("ij,ij->i", m, m) * (q @ q)
    return np.where(n == 0, 0.0, -s * np.abs(s) / np.where(n == 0, 1.0, n))


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of two matrices, row by row."""
    if metric == "l2":
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    if metric == "hamming":
        return np.bitwise_count(a ^ b).sum(1).astype(np.float64)
    s = np.einsum("ij,ij->i", a, b)
    if metric == "ip":
        return -s
    n = np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)
    return np.where(n == 0, 0.0, -s * np.abs(s) / np.where(n == 0, 1.0, n))


def between(metric: str, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """About all distances of the rows of two matrices, by one matrix product, and how far they may be off for each row of ``q``."""
    if metric == "hamming":
        return np.stack([to_rows(metric, x, m) for x in q]) if len(q) else np.zeros((0, len(m))), np.zeros(len(q))
    s = q @ m.T
    qq, mm = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", m, m)
    if metric == "cos":
        n = qq[:, None] * mm[None]
        return np.where(n == 0, 0.0, -s * np.abs(s) / np.where(n == 0, 1.0, n)), np.full(len(q), 1e-9)
    return (qq[:, None] + mm[None] - 2 * s if metric == "l2" else -s), 1e-11 * (qq + mm.max(initial=0))


#: Norms between which single precision tells distances by a bound of its own.
_LEAST, _MOST = 1e-60, 1e60


def _plain(m: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Norms of rows, the largest (1 if all are 0), and whether all are finite and neither tiny nor huge."""
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = bool(np.isfinite(n).all() and ((n == 0) | (n > _LEAST) & (n < _MOST)).all())
    return n, float(n.max(initial=0)) or 1.0, ok


def _pairs(m: np.ndarray) -> np.ndarray | None:
    """32-bit words two by two, as rows of 64-bit words; None where words are longer or negative."""
    if m.ndim != 2 or not 0 < m.shape[1] or m.size and not 0 <= m.min() <= m.max() < 1 << 32:
        return None
    out = np.zeros((len(m), m.shape[1] + m.shape[1] % 2), np.uint32)
    out[:, : m.shape[1]] = m
    return out.view(np.uint64)


class Asked:
    """Queries ready for scores in single precision: numbers that order the rows of a matrix as their distances do, for each
    query, up to a bound on what rounding may do. For l2 a score is m.m / 2 - q.m, else -q.m, of unit vectors for cos; all
    in units of the largest norms. For hamming it is the distance."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.ok = metric, q.ndim == 2 and q.shape[1] > 0
        if metric == "hamming":
            self.q = _pairs(q) if self.ok else None
            self.ok = self.q is not None
        elif self.ok:
            self.norm, self.scale, self.ok = _plain(q)
        if self.ok and metric != "hamming":
            by = np.where(self.norm == 0, 1.0, self.norm)[:, None] if metric == "cos" else self.scale
            self.q = (-q / by).astype(np.float32)
            if metric == "l2":
                self.q = np.concatenate((self.q, np.ones((len(q), 1), np.float32)), 1)

    def meets(self, m: np.ndarray) -> Meeting | Crossing | None:
        """Scores of the rows of ``m``; None where single precision says nothing."""
        if not self.ok or not len(m):
            return None
        if self.metric == "hamming":
            words = _pairs(m)
            return None if words is None else Crossing(self, words)
        norm, scale, ok = _plain(m)
        return Meeting(self, m, norm, scale) if ok and 1e-15 < scale / self.scale < 1e15 else None


class Meeting:
    def __init__(self, asked: Asked, m: np.ndarray, norm: np.ndarray, scale: float):
        self.asked, metric = asked, asked.metric
        self.unit = 1.0 if metric == "cos" else asked.scale * scale
        by = np.where(norm == 0, 1.0, norm)[:, None] if metric == "cos" else scale
        self.m = (m / by).astype(np.float32)
        size, self.add = np.ones(len(asked.q)) if metric == "cos" else asked.norm / asked.scale, 0.0
        if metric == "l2":
            half = norm**2 / (2 * self.unit)
            self.m, self.add = np.concatenate((self.m, half[:, None].astype(np.float32)), 1), half.max()
        # Rounding of the two factors, of a product and of a sum in any order, for each component.
        self.off = (m.shape[1] + 5) * 2.0**-24 * 1.1 * (size + self.add) + (1e-7 if metric == "cos" else 1e-30)

    def scores(self, i: slice) -> np.ndarray:
        return self.asked.q[i] @ self.m.T

    def most(self, i: slice, bound: np.ndarray) -> np.ndarray:
        """The largest score that a row within ``bound`` of each query may have."""
        if self.asked.metric == "cos":
            top = np.sign(bound) * np.sqrt(np.abs(bound))
        elif self.asked.metric == "ip":
            top = bound / self.unit
        else:
            qq = self.asked.norm[i] ** 2
            top = (bound - qq) / (2 * self.unit) + 1e-14 * (qq + np.abs(bound)) / self.unit
        return top + self.off[i] + 2e-7 * np.abs(top)


class Crossing:
    """Codes compared word by word, a query with all rows at a time."""

    def __init__(self, asked: Asked, words: np.ndarray):
        self.asked, self.m = asked, np.ascontiguousarray(words.T)
        self.off = np.zeros(len(asked.q), np.float32)

    def scores(self, i: slice) -> np.ndarray:
        q, n = self.asked.q[i], self.m.shape[1]
        out, differ, count = np.zeros((len(q), n), np.uint16 if len(self.m) < 1024 else np.uint32), np.empty(n, np.uint64), np.empty(n, np.uint8)
        wide = np.empty(n, out.dtype)  # adding bytes to it is several times slower
        for row, own in zip(out, q, strict=True):
            for word, bits in zip(self.m, own, strict=True):
                np.bitwise_xor(word, bits, out=differ)
                np.bitwise_count(differ, out=count)
                wide[:] = count
                row += wide
        return out.astype(np.float32)

    def most(self, i: slice, bound: np.ndarray) -> np.ndarray:
        return bound
