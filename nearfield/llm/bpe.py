"""Byte-level BPE over Arrow batches: encode, offsets, decode."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.base import map_batches
from nearfield.llm.vocab import Pieces, rank_tokenizer, read_ranks

#: A space before a non-space always starts a match of the pattern, so a text may be cut there without changing its tokens.
_CUT = re.compile(r" (?=\S)")
_UNCUT = re.compile(r" (?!\S)")
#: Texts that are encoded together, in characters.
_TOGETHER = 1 << 21


class ByteBPE:
    """Encodes as the rank file says, without special tokens; decodes by the reversed byte table."""

    _made: dict[tuple[str, str], ByteBPE] = {}

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pieces = Pieces(rank_tokenizer(ranks, pattern), pattern, lower=False)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    @classmethod
    def get(cls, path: str, pattern: str) -> ByteBPE:
        """One for each worker: the vocabulary and the pieces it knows outlive a task."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    @staticmethod
    def cut(text: str) -> list[str]:
        if not text:
            return []
        head, *rest = _CUT.split(text) if _UNCUT.search(text) else text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.pieces.encode_texts(texts, self.cut)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> list[str]:
        """The text that each token completes; a character split over tokens comes with the one that ends it."""
        out, held = [], b""
        for i in ids.tolist():
            held += self.bytes_of[i]
            try:
                out.append(held.decode())
                held = b""
            except UnicodeDecodeError as e:
                whole = held[: e.start].decode() if e.reason == "unexpected end of data" else held.decode("utf-8", "replace")
                held = held[e.start :] if e.reason == "unexpected end of data" else b""
                out.append(whole)
        if held:
            out[-1] += held.decode("utf-8", "replace")
        return out

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Per token its first and last-but-one character; tokens inside one character share that character."""
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        char = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
        return np.stack([char[starts] - 1, char[ends - 1]], 1) if len(ids) else np.zeros((0, 2), np.int64)


def _groups(texts: list[str]) -> Iterator[slice]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _TOGETHER):
            size += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ids array<int>, and with ``offsets`` starts and ends, array<int> of characters.

    Null and empty texts have no tokens. Rows stay as they are, repeated or not; other columns are left out.
    """

    def make():
        bpe = ByteBPE.get(path, pattern)

        def run(b: pa.RecordBatch):
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s in _groups(texts):
                ids = bpe.encode(texts[s])
                columns = [b.column(0)[s.start : s.stop], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if offsets:
                    at = [bpe.offsets(t, x).astype(np.int32) for t, x in zip(texts[s], ids, strict=True)]
                    columns += [pa.array([a[:, k] for a in at], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "starts", "ends"][: len(columns)])

        return run

    kind = docs.schema[key].dataType.simpleString()
    out = map_batches(docs.select(key, text), make, f"key {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)
    return out.withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: ``key`` and the decoded bytes; null ids give null, no ids give no bytes."""

    def make():
        bpe = ByteBPE.get(path, pattern)

        def run(b: pa.RecordBatch):
            data = [None if x is None else bpe.decode_bytes(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["key", "data"])

        return run

    kind = tokens.schema[key].dataType.simpleString()
    return map_batches(tokens.select(key, ids), make, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256, n_split; encodes, decodes and keeps the
    digests only.

    offsets_sha256 is of the first and last-but-one character of each token, pairs of little-endian 32-bit integers;
    n_split counts the tokens that end inside a character. Null texts are empty; repeated rows stay.
    """

    def make():
        bpe = ByteBPE.get(path, pattern)

        def digest(x) -> str:
            return hashlib.sha256(x).hexdigest()

        def run(b: pa.RecordBatch):
            texts = [x or "" for x in b.column(1).to_pylist()]
            for s in _groups(texts):
                ids = bpe.encode(texts[s])
                at = [bpe.offsets(t, x) for t, x in zip(texts[s], ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[s.start : s.stop],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([digest(x.data) for x in ids]),
                        pa.array([digest(bpe.decode_bytes(x)) for x in ids]),
                        pa.array([digest(x.astype("<i4").tobytes()) for x in at]),
                        pa.array([int((x[1:, 0] < x[:-1, 1]).sum()) for x in at], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"],
                )

        return run

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")
