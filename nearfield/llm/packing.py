"""Vector bin packing of token sequences by the dot-product heuristic.

A bin has room for tokens, segments and loss-bearing tokens at once. The open bin takes the kind of example whose
demand, in parts of the capacities, has the largest dot product with the room left. Examples over a bin's size are cut
into full bins first; if no whole example fits, one is cut to fill the bin.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.vocab import Pieces, file_pattern, file_tokenizer

#: Tokens that are packed together; a task holds no more than these and one batch.
WINDOW_TOKENS = 1 << 21


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


@dataclass
class Segment:
    """Tokens ``start`` to ``start + length`` of example ``of``, whose first ``prompt`` tokens bear no loss."""

    of: int
    start: int
    length: int
    prompt: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def head(self, length: int) -> Segment:
        return Segment(self.of, self.start, length, self.prompt)

    def tail(self, length: int) -> Segment:
        return Segment(self.of, self.start + length, self.length - length, self.prompt)

    def most(self, tokens: int, loss: int) -> int:
        """The longest head within both limits."""
        free = max(0, self.prompt - self.start)
        return min(self.length, tokens, free + loss)


def pack(segments: list[Segment], limits: Limits, cut: bool = True) -> tuple[list[list[Segment]], list[Segment]]:
    """Closed bins, and the last bin's content if it is still open (tokens and segments are left).

    Without ``cut``, an example over the limits raises ValueError. Segments of no tokens take no part.
    """
    bins: list[list[Segment]] = []
    kinds: dict[tuple[int, int], list[Segment]] = defaultdict(list)
    for s in segments:
        while s.length and (s.length > limits.tokens or s.loss > limits.loss):
            if not cut:
                raise ValueError(f"example {s.of} is over the limits")
            n = s.most(limits.tokens, limits.loss)
            bins.append([s.head(n)])
            s = s.tail(n)
        if s.length:
            kinds[s.length, s.loss].append(s)
    if not kinds:
        return bins, []
    keys = sorted(kinds)
    tokens, loss = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    left = np.array([len(kinds[k]) for k in keys])
    want_t, want_l = tokens / limits.tokens, loss / limits.loss
    row = {k: i for i, k in enumerate(keys)}
    total = int(left.sum())
    open_: list[Segment] = []
    room = [limits.tokens, limits.segments, limits.loss]

    def put(s: Segment) -> None:
        open_.append(s)
        room[0] -= s.length
        room[1] -= 1
        room[2] -= s.loss

    while total:
        if not (room[0] and room[1]):
            bins.append(open_)
            open_, room[:] = [], [limits.tokens, limits.segments, limits.loss]
        upto = int(np.searchsorted(tokens, room[0], "right"))
        fits = (left[:upto] > 0) & (loss[:upto] <= room[2])
        if fits.any():
            gain = want_t[:upto] * (room[0] / limits.tokens) + want_l[:upto] * (room[2] / limits.loss)  # a segment's part is the same for all
            i = int(np.where(fits, gain, -1.0).argmax())
            put(kinds[keys[i]].pop())
            left[i] -= 1
            total -= 1
            continue
        i = int(np.flatnonzero(left)[0])
        n = kinds[keys[i]][-1].most(room[0], room[2]) if cut else 0
        if n:
            s = kinds[keys[i]].pop()
            put(s.head(n))
            left[i] -= 1
            rest = s.tail(n)
            k = (rest.length, rest.loss)
            if k in row:
                kinds[k].append(rest)
                left[row[k]] += 1
            else:  # a kind not seen before: the arrays grow by it
                kinds[k].append(rest)
                at = int(np.searchsorted(tokens, k[0]))
                keys.insert(at, k)
                tokens, loss, left = np.insert(tokens, at, k[0]), np.insert(loss, at, k[1]), np.insert(left, at, 1)
                want_t, want_l = tokens / limits.tokens, loss / limits.loss
                row = {k: i for i, k in enumerate(keys)}
        else:
            bins.append(open_)
            open_, room[:] = [], [limits.tokens, limits.segments, limits.loss]
    if room[0] and room[1]:
        return bins, open_
    return [*bins, open_], []


def trimmed(content: list[Segment], limits: Limits) -> Iterator[list[Segment]]:
    """A bin short of tokens as sequences of a power of two each, which need no padding."""
    size = sum(s.length for s in content)
    if size == limits.tokens:
        yield content
        return
    rest = list(reversed(content))
    while size:
        n = want = 1 << (size.bit_length() - 1)
        out = []
        while want:
            s = rest.pop()
            if s.length > want:
                rest.append(s.tail(want))
                s = s.head(want)
            out.append(s)
            want -= s.length
        size -= n
        yield out


class _Packer:
    """A task's state: token bytes of examples that are not all placed, and how many sequences it has made."""

    def __init__(self, limits: Limits):
        self.limits, self.ids, self.keys, self.pool, self.made, self.held = limits, {}, {}, [], 0, 0
        self.task = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.n = 0

    def add(self, key, ids: bytes, prompt: int = 0) -> None:
        self.keys[self.n], self.ids[self.n] = key, ids
        self.pool.append(Segment(self.n, 0, len(ids) // 4, prompt))
        self.held += len(ids) // 4
        self.n += 1

    def flush(self, last: bool) -> Iterator[tuple]:
        bins, open_ = pack(self.pool, self.limits)
        for content in [*bins, *([open_] if last and open_ else [])]:
            for sequence in trimmed(content, self.limits):
                at = 0
                for s in sequence:
                    ids = self.ids[s.of]
                    yield (self.keys[s.of], s.start, s.length, zlib.crc32(memoryview(ids)[4 * s.start : 4 * (s.start + s.length)]), len(ids) // 4, self.task << 40 | self.made, at, s.loss)
                    at += s.length
                self.made += 1
        self.pool = [] if last else open_
        kept = {s.of for s in self.pool}
        self.ids, self.keys = ({k: v for k, v in d.items() if k in kept} for d in (self.ids, self.keys))
        self.held = sum(s.length for s in self.pool)


_pieces: dict[str, Pieces] = {}


def _tokenizer(path: str) -> Pieces:
    """One for each worker."""
    if path not in _pieces:
        _pieces[path] = Pieces(file_tokenizer(path), file_pattern(path), lower=True)
    return _pieces[path]


def _words(text: str) -> list[bytes]:
    """A text cut at ASCII white space, which the vocabulary drops."""
    return text.encode().split()


def pack_documents(docs: DataFrame, path: str, end: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Tokenize and pack texts; every token bears loss, so that the limits on tokens and on loss coincide.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the end
    token alone. Repeated rows are packed each for itself; doc_id may be null; other columns are left out; an empty table
    gives no rows. Each task packs its own rows, a window at a time, and only its last sequences are short: they are cut
    at powers of two.
    """

    def run(batches):
        pieces, packer, stop = _tokenizer(path), _Packer(limits), np.array([end], "<u4").tobytes()

        def out(rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), pieces.encode_texts(texts, _words), strict=True):
                    packer.add(key, ids + stop)
                if packer.held >= WINDOW_TOKENS and (rows := [r[:-1] for r in packer.flush(False)]):
                    yield out(rows)
        if rows := [r[:-1] for r in packer.flush(True)]:
            yield out(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def instructions(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """(conv_id, turn, prompt, response): each turn of ``role`` with the turn before it.

    Prompts are found by conversation and turn, so no task holds a conversation. Of several rows with one turn the least
    text is the prompt; each row of ``role`` is a response. Null texts are empty; without a turn before, or with a null
    conv_id or turn, the prompt is empty.
    """
    before = conversations.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    said = conversations.where(F.col("role") == role).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("response"))
    return said.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("prompt", F.lit("")).alias("prompt"), "response")


def pack_instructions(rows: DataFrame, path: str, keys: list[str], end: int = 2, limits: Limits = Limits(4096, 64, 2048)) -> DataFrame:
    """Tokenize and pack instruction data: rows with ``keys`` and columns prompt and response.

    An example is its prompt's tokens, its response's and the end token; only those after the prompt bear loss. A
    sequence keeps all three limits. Per piece: the keys, start, length, loss_tokens, ids_crc32, example_tokens,
    prompt_tokens, sequence_id, offset. An example over a limit is cut, and one more to fill a sequence that no whole one
    fits. Null prompts and responses are empty; repeated rows are packed each for itself; other columns are left out.
    """
    n = len(keys)

    def run(batches):
        pieces, packer, stop = _tokenizer(path), _Packer(limits), np.array([end], "<u4").tobytes()

        def out(made) -> Iterator[pa.RecordBatch]:
            if made:
                own, start, length, crc, whole, sequence, at, loss = zip(*made, strict=True)
                columns = [pa.array(c, t) for c, t in zip(zip(*[k[:n] for k in own], strict=True), types, strict=True)]
                columns += [pa.array(c, pa.int64()) for c in (start, length, loss, crc, whole, [k[n] for k in own], sequence, at)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

        types = None
        for b in batches:
            types = [b.schema.field(k).type for k in range(n)]
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                prompt, response = (pieces.encode_texts([x or "" for x in part.column(n + k).to_pylist()], _words) for k in (0, 1))
                for key, p, r in zip(zip(*(part.column(k).to_pylist() for k in range(n)), strict=True), prompt, response, strict=True):
                    packer.add((*key, len(p) // 4), p + r + stop, len(p) // 4)
                if packer.held >= WINDOW_TOKENS:
                    yield from out(list(packer.flush(False)))
        yield from out(list(packer.flush(True)))

    names = ["start", "length", "loss_tokens", "ids_crc32", "example_tokens", "prompt_tokens", "sequence_id", "offset"]
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{x} long" for x in names])
    return rows.select(*keys, "prompt", "response").mapInArrow(run, schema)
