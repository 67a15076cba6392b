"""Toxicity by a chain of linear classifiers over hashed words.

The categories are predicted one after the other; each model after the first also sees the probabilities of the
categories before it. In training those are out-of-fold predictions, so that no model learns to trust a probability
that was fitted on the same row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.base import map_batches

#: Labelled documents to fit on (those of the least hashed doc_id), each with all its features.
SAMPLE = 6000
#: Hash space, documents that a feature must be in, features that a model keeps, folds, steps and the penalty of the fit.
WIDTH, LEAST_DOCS, KEPT, FOLDS, STEPS, PENALTY = 1 << 20, 3, 3000, 3, 60, 1.0
#: Features of rows worked on at once.
CHUNK = 1 << 19
#: A row is never flagged below this probability.
LEAST_SURE = 0.35
#: A word's beginnings of these lengths are features as well: inflected and compounded words share them.
STEMS = (3, 4, 5, 7)
#: Words that a worker remembers; beyond so many it starts anew.
KNOWN = 250_000
#: The chain, in order: from what the labels (quality, toxic) say.
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")
_WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")


def _forms(word: str) -> list[int]:
    """Places of a word and its beginnings in the hash space."""
    return [zlib.crc32(f.encode()) & (WIDTH - 1) for f in (word, *[word[:k] + "*" for k in STEMS if len(word) > k])]


def hashed_words(text: str) -> np.ndarray:
    """Distinct words (runs of letters in lower case, runs of signs) and their beginnings as sorted places in the hash space."""
    places = {p for w in set(_WORD.findall(text.lower())) for p in _forms(w)}
    return np.sort(np.fromiter(places, np.int32, len(places)))


@dataclass
class Rows:
    """Binary features of rows, one row after the other; worked on CHUNK of them at a time."""

    index: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*rows, np.zeros(0, np.int32)]), np.array([len(r) for r in rows], np.int64))

    def _chunks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Rows from and to, their features, and the row of each feature, counted from the first."""
        end, i = np.cumsum(self.size), 0
        while i < len(end):
            before = end[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(end, before + CHUNK, "right")))
            yield i, j, self.index[before : end[j - 1]], np.repeat(np.arange(j - i), self.size[i:j])
            i = j

    def take(self, rows: np.ndarray) -> Rows:
        end = np.cumsum(self.size)
        return Rows.of([self.index[end[r] - self.size[r] : end[r]] for r in rows.tolist()])

    def only(self, features: np.ndarray, width: int) -> Rows:
        """The rows with these features alone, numbered anew."""
        place = np.full(width, -1, np.int32)
        place[features] = np.arange(len(features))
        index, size = [np.zeros(0, np.int32)], np.zeros(len(self.size), np.int64)
        for i, j, own, row in self._chunks():
            own = place[own]
            size[i:j] = np.bincount(row[own >= 0], minlength=j - i)
            index.append(own[own >= 0])
        return Rows(np.concatenate(index), size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size))
        for i, j, own, row in self._chunks():
            out[i:j] = np.bincount(row, weights=w[own], minlength=j - i)
        return out

    def back(self, v: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        for i, _, own, row in self._chunks():
            out += np.bincount(own, weights=v[i + row], minlength=width)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on words scaled by their log-count ratio, on earlier log-odds and on a constant."""

    words: np.ndarray
    earlier: np.ndarray
    constant: float

    def predict(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.words) + before @ self.earlier + self.constant)


def fit_linear(x: Rows, before: np.ndarray, y: np.ndarray, width: int) -> Linear:
    """Accelerated gradient steps on the penalised loss; labels all alike give a constant."""
    k = before.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Linear(np.zeros(width), np.zeros(k), 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    pos, neg = x.back(y, width) + 0.5, x.back(1.0 - y, width) + 0.5
    pick = np.sort(np.argsort(-_spread(pos, neg, y), kind="stable")[:KEPT])
    x, pos, neg, whole, width = x.only(pick, width), pos[pick], neg[pick], width, len(pick)
    ratio = np.log(pos / (y.sum() + 1)) - np.log(neg / (len(y) - y.sum() + 1))
    scale = np.abs(ratio)
    w, b = np.zeros(width), np.zeros(k + 1)
    b[k] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    more = np.concatenate([before, np.ones((len(y), 1))], 1)
    # Curvature of each weight, from above: steps suit rare and frequent words alike.
    hw, hb = np.zeros(width) + PENALTY, 0.25 * (more**2).sum(0) + PENALTY
    hw += 0.25 * scale**2 * x.back(x.dot(scale) / np.maximum(scale.mean(), 1e-9) * 0.05 + 1.0, width)
    vw, vb, t = w, b, 1.0
    for _ in range(STEPS):
        e = _sigmoid(x.dot(scale * vw) + more @ vb) - y
        nw = vw - (scale * x.back(e, width) + PENALTY * vw) / hw
        nb = vb - (more.T @ e + np.append(np.full(k, PENALTY), 0.0) * vb) / hb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        if (e @ (x.dot(scale * (nw - w)) + more @ (nb - b))) > 0:  # overshot: start the momentum anew
            vw, vb, nt = nw, nb, 1.0
        w, b, t = nw, nb, nt
    words = np.zeros(whole)
    words[pick] = scale * w
    return Linear(words, b[:k], float(b[k]))


def _spread(pos: np.ndarray, neg: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far each feature's rates in the two classes lie apart, in standard deviations."""
    n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
    p = (pos + neg) / (n1 + n0)
    return np.abs(pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)


def _odds(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1 - 1e-4))


@dataclass
class Chain:
    """``place``: for the places of the hash space that a model uses, the feature's number as four bytes."""

    categories: tuple[str, ...]
    place: dict[int, bytes]
    models: list[Linear]
    thresholds: list[float]
    known: dict[str, bytes] = field(default_factory=dict)

    def features(self, text: str) -> np.ndarray:
        """The text's distinct features; each new word is looked up once and remembered, up to KNOWN words."""
        words = set(_WORD.findall(text.lower()))
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = b"".join(self.place[p] for p in _forms(w) if p in self.place)
        return np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4"))

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, texts x categories; words that the models don't use count for nothing."""
        at = [self.features(t) for t in texts]
        x = Rows.of(at)
        before = np.zeros((len(texts), 0))
        out = np.zeros((len(texts), len(self.models)))
        for i, m in enumerate(self.models):
            out[:, i] = m.predict(x, before)
            before = np.concatenate([before, _odds(out[:, i : i + 1])], 1)
        return out


def fit_chain(words: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Fit on rows of hashed words and 0/1 labels (rows x categories)."""
    n = len(words)
    x = Rows.of(words)
    known = np.flatnonzero(x.back(np.ones(n), WIDTH) >= LEAST_DOCS)
    x = x.only(known, WIDTH)
    fold = np.arange(n) % FOLDS
    before, models, thresholds = np.zeros((n, 0)), [], []
    for i in range(len(categories)):
        y = labels[:, i].astype(float)
        out = np.zeros(n)
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own):
                out[own] = fit_linear(x.take(rest), before[rest], y[rest], len(known)).predict(x.take(own), before[own])
        models.append(fit_linear(x, before, y, len(known)))
        thresholds.append(best_threshold(out, y))
        before = np.concatenate([before, _odds(out)[:, None]], 1)
    used = np.flatnonzero(np.any([m.words != 0 for m in models], 0))
    numbered = {int(p): i.to_bytes(4, "little") for i, p in enumerate(known[used])}
    return Chain(categories, numbered, [Linear(m.words[used], m.earlier, m.constant) for m in models], thresholds)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold predictions have the best F1, and no less than LEAST_SURE (0.5 where a category has no rows)."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return max(LEAST_SURE, float(p[order][at] + below) / 2)  # halfway to the next row


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit on SAMPLE labelled documents at most; rows with null labels or ids take no part, null texts are empty.

    Of several label rows of one doc_id the one of the largest quality, and of those of the largest toxic, counts.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(SAMPLE)
    )
    rows = picked.collect()
    label = {r["doc_id"]: (1 - r["quality"], r["toxic"]) for r in rows}
    ids = docs.sparkSession.createDataFrame([(k,) for k in label], "doc_id long")  # SAMPLE ids at most

    def make():
        def run(b: pa.RecordBatch):
            words = [hashed_words(t or "").astype(">i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["doc_id", "words"])

        return run

    # Only the texts that were picked leave the JVM.
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    # Of rows of one doc_id the one whose features sort first, so that SAMPLE rows come back at most.
    found = map_batches(own, make, "doc_id long, words binary").groupBy("doc_id").agg(F.min("words").alias("words"))
    seen = {r["doc_id"]: np.frombuffer(r["words"], ">i4").astype(np.int32) for r in found.toLocalIterator()}
    keys = sorted(seen, key=lambda k: (zlib.crc32(str(k).encode()), k))
    y = np.array([(q, t, q and t) for q, t in map(label.get, keys)], float).reshape(-1, len(CATEGORIES))
    return fit_chain([seen.pop(k) for k in keys], y, CATEGORIES)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row: doc_id, ``toxic`` (beyond the threshold), and p_<category>, a probability for each category.

    Null and empty texts have no words and the base rates. Repeated rows stay; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # WIDTH places and fewer weights: bounded
    toxic = chain.categories.index("toxic")
    names = ["doc_id", "toxic", *[f"p_{c}" for c in chain.categories]]

    def make():
        chain = shared.value

        def run(b: pa.RecordBatch):
            p = chain.predict([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, toxic] > chain.thresholds[toxic]), *[pa.array(c) for c in p.T]], names=names)

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, toxic boolean, " + ", ".join(f"p_{c} double" for c in chain.categories))


def unflagged(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` would not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    toxic, text = chain.categories.index("toxic"), docs.columns.index("text")

    def make():
        chain = shared.value

        def run(b: pa.RecordBatch):
            p = chain.predict([t or "" for t in b.column(text).to_pylist()])[:, toxic]
            yield b.filter(pa.array(p <= chain.thresholds[toxic]))

        return run

    return map_batches(docs, make, docs.schema)
