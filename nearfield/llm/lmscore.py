"""Cross-entropy difference of documents under a target and a background bigram model.

Both models count over all documents: the background every one, the target those that are marked. They share the
vocabulary (all words of the corpus and an end sign), the order and the smoothing: p(v | u) = (c(u v) + a) / (c(u) + a V).
A document is scored against the rest of the corpus: its own counts are taken off first.

The loss of a document is then a sum over its word pairs and over their first words, each term needing the two counts of
one key. So keys, not texts, are dealt out: a task sends the keys of a few thousand documents, a pack, in packed arrays,
one for each range of the key space. A first pass adds up the counts of each range. Keys of a single document need no
entry, as nothing is left once its own counts are off. A second pass meets the packs' keys with those counts, range by
range, and sends back sums, which meet again pack by pack; ranges that are large, because a key is in very many
documents, are split over several tasks. Ranges hold about RANGE_BYTES of text each and have a partition of their own,
so tasks stay as they are while the input grows.

A pack has a row for each range. So that their number grows with the input and not with its square, a pack is dealt out
over FAN ranges at most. Where more are needed those are dealt out in turn: what packs have in one of them is put
together into bundles, and each bundle is dealt out over the ranges within. Sums go back the same way.

Keys are hashes of KEY_BITS more bits than the text's size has, 63 at most, so that about one key in a million shares its
hash with another one up to 8 TB of text, and one in some hundred thousand at 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, materialize, mix, utf8, word_hashes

#: Added count; bytes of text that are packed together and documents at most; bytes of text for a range of keys; keys of documents that one task meets.
ADDED, TOGETHER, MOST_DOCS, RANGE_BYTES, MEET = 0.05, 5 << 20, 50_000, 8 << 20, 8 << 20
#: Target documents whose ids are sent to all tasks; beyond, documents are joined with them.
BROADCAST_IDS = 4 << 20
KEY_BITS = 19
#: Ranges that a pack or a bundle is dealt out over, bytes of a bundle, and tasks of a stage at most.
FAN, BUNDLE_BYTES, MOST_TASKS = 4096, 16 << 20, 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_START, _END = np.uint64(0x51A7), np.uint64(0xE0D)
_NONE = np.iinfo(np.int64).min  # stands for a null doc_id


def planes(x: np.ndarray) -> bytes:
    """Non-negative integers as their first bytes, then their second ones and so on: zeros stand together and compress."""
    x = np.ascontiguousarray(x, "<u8")
    n = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([n]) + x.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    n = b[0]
    out = np.zeros(((len(b) - 1) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8, offset=1).reshape(n, -1).T
    return out.view("<u8").ravel()


def signed_planes(x: np.ndarray) -> bytes:
    least = np.array([x.min() if len(x) else 0], "<i8")
    return least.tobytes() + planes(x - least[0])


def signed_unplanes(b: bytes) -> np.ndarray:
    return unplanes(b[8:]).view(np.int64) + np.frombuffer(b, "<i8", 1)[0]


def keys_of(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens' first words (even) and word pairs (odd), the text of each key, and the tokens of each text."""
    h, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    end = np.cumsum(n) + np.arange(len(texts))
    seq = np.insert(h, np.cumsum(n), _END)  # words and an end for each text
    owner = np.insert(doc, np.cumsum(n), np.arange(len(texts)))
    first = np.roll(seq, 1)
    first[end - n] = _START
    low = np.uint64((1 << bits) - 2)
    word = mix(first + _ODD) >> np.uint64(64 - bits) & low
    pair = mix(mix(first * _ODD) + seq) >> np.uint64(64 - bits) & low | np.uint64(1)
    owner = owner.astype(np.int32)
    return np.concatenate([word, pair]), np.concatenate([owner, owner]), n + 1


def _among(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ids."""
    if not len(ids):
        return np.zeros(len(x), bool)
    return ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x


def _packs(batches: Iterator[pa.RecordBatch], marked, bits: int) -> Iterator[tuple]:
    """Of some thousand documents at a time: doc_ids, marks, tokens, and the postings key, doc, count in order of key."""
    ids, marks, texts, size = [], [], [], 0

    def pack():
        key, doc, tokens = keys_of(texts, bits)
        order = np.argsort(key, kind="stable")  # texts are in order already
        key, doc = key[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
        count = np.diff(np.append(at, len(key)))
        return np.array(ids, np.int64), np.array(marks, bool), tokens, key[at], doc[at], count

    for b in batches:
        i = b.column(0).fill_null(_NONE).to_numpy()
        m = b.column(2).to_pylist() if marked is None else _among(i, marked).tolist()
        for d, t, x in zip(i.tolist(), utf8(b.column(1)), m, strict=True):
            ids.append(d)
            marks.append(x)
            texts.append(t)
            size += len(t)
            if size >= TOGETHER or len(ids) >= MOST_DOCS:
                yield pack()
                ids, marks, texts, size = [], [], [], 0
    if ids:
        yield pack()


def _ranges(key: np.ndarray, n: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """Those of ``n`` ranges that have any of the sorted keys, and the places of their first and last-but-one key."""
    if len(key):
        first, last = ((int(k) * n >> bits) for k in (key[0], key[-1]))
        first, last = max(0, first - 1), min(n, last + 2)
        edge = np.searchsorted(key, np.array([(i << bits) // n for i in range(first, last + 1)], np.uint64))
        yield from ((i, int(a), int(b)) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), first) if b > a)


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _counting(n: int, bits: int, shared):
    def run(batches):
        for _, marks, _, key, doc, count in _packs(batches, shared and shared.value, bits):
            rows = []
            for r, a, b in _ranges(key, n, bits):
                at = _firsts(key[a:b])
                total = np.add.reduceat(count[a:b], at)
                mine = np.add.reduceat(count[a:b] * marks[doc[a:b]], at)
                docs = np.diff(np.append(at, b - a))
                rows.append((r, planes(np.diff(key[a:b][at], prepend=np.uint64(0))), planes(total), planes(mine), planes(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["part", "keys", "total", "mine", "docs"])

    return run


def _summed(key, group):
    """The counts of a range: keys of two documents or more, and how many words and keys of documents it has."""
    k, total, mine, docs = (np.concatenate([f(x) for x in group[c].to_pylist()]) for c, f in (("keys", lambda x: np.cumsum(unplanes(x), dtype=np.uint64)), ("total", unplanes), ("mine", unplanes), ("docs", unplanes)))
    order = np.argsort(k, kind="stable")
    k, at = k[order], None
    at = _firsts(k)
    total, mine, docs = (np.add.reduceat(x[order], at) for x in (total, mine, docs))
    k, keep = k[at], docs > 1
    own = k[keep]
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([planes(np.diff(own, prepend=np.uint64(0)))], pa.binary()), "total": pa.array([planes(total[keep])], pa.binary()), "mine": pa.array([planes(mine[keep])], pa.binary()), "words": pa.array([int((k & np.uint64(1) == 0).sum())], pa.int64()), "postings": pa.array([int(docs.sum())], pa.int64())})


#: What the keys of a pack in one range are sent as; ``part`` under 0 is the pack's own row: ids, and tokens as ``count``.
_DEALT = "part int, keys binary, docs binary, doc binary, count binary, ids binary, marks binary, pack long"


def _dealt(key: np.ndarray, doc: np.ndarray, count: np.ndarray, marks: np.ndarray, n: int, bits: int, pack: int) -> Iterator[tuple]:
    """Rows of a pack's or bundle's postings, which are in order of key: one for each of ``n`` ranges."""
    for r, a, b in _ranges(key, n, bits):
        at = _firsts(key[a:b])
        some, short = np.unique(doc[a:b], return_inverse=True)
        yield (r, planes(np.diff(key[a:b][at], prepend=np.uint64(0))), planes(np.diff(np.append(at, b - a))), planes(short), planes(count[a:b]), planes(some), np.packbits(marks[some]).tobytes(), pack)


def _dealing(n: int, bits: int, shared):
    def run(batches):
        # Packs are numbered by the task, whose rows come in one order: those of files, or of a table written for this.
        pack = TaskContext.get().partitionId() << 32
        for ids, marks, tokens, key, doc, count in _packs(batches, shared and shared.value, bits):
            rows = [(-1 - pack % n, b"", b"", b"", planes(tokens), ids.tobytes(), b"", pack), *_dealt(key, doc, count, marks, n, bits, pack)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 6, pa.int64()], strict=True)], names=["part", "keys", "docs", "doc", "count", "ids", "marks", "pack"])
            pack += 1

    return run


def _losses(vocabulary: int):
    """Of one range and one share of its packs: for each pack the places of documents in it and their summed log terms. A
    pack's own row passes through, its tokens in the place of terms."""
    wide = ADDED * vocabulary

    def run(left, right):
        known = np.cumsum(unplanes(right["keys"][0].as_py()), dtype=np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        total, mine = (unplanes(right[c][0].as_py()).astype(np.int64) if right.num_rows else np.zeros(0, np.int64) for c in ("total", "mine"))
        out = []
        for part, pack, keys, docs, doc, count, ids, marks in zip(*(left[c].to_pylist() for c in ("part", "pack", "keys", "docs", "doc", "count", "ids", "marks")), strict=True):
            if part < 0:
                out.append((pack, ids, count, None))
                continue
            key = np.repeat(np.cumsum(unplanes(keys), dtype=np.uint64), unplanes(docs).astype(np.int64))
            doc, count, n = unplanes(doc).astype(np.int64), unplanes(count).astype(np.int64), len(unplanes(ids))
            marks = np.unpackbits(np.frombuffer(marks, np.uint8), count=n)
            at = np.searchsorted(known, key)
            there = at < len(known)
            there[there] = known[at[there]] == key[there]
            rest, good = np.zeros(len(key)), np.zeros(len(key))
            rest[there] = total[at[there]] - count[there]
            good[there] = mine[at[there]] - count[there] * marks[doc[there]]
            pair = (key & np.uint64(1)).astype(bool)
            sign, base = np.where(pair, -1.0, 1.0) * count, np.where(pair, ADDED, wide)
            # In whole billionths, so that later sums are the same in any order.
            t, b = (signed_planes(np.rint(1e9 * np.bincount(doc, weights=sign * np.log(x + base), minlength=n)).astype(np.int64)) for x in (good, rest))
            out.append((pack, ids, t, b))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["pack", "ids", "t", "b"])

    return run


def _runs_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows of whole columns, in runs of one ``part`` and of BUNDLE_BYTES; those under 0, which stand alone, one by one."""
    held, part, size = [], None, 0
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if held and (row[0] != part or size >= BUNDLE_BYTES or part < 0):
                yield held
                held, size = [], 0
            held.append(row)
            part = row[0]
            size += sum(len(x) for x in row if isinstance(x, bytes))
    if held:
        yield held


def _keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed), dtype=np.uint64)


_COUNTED = "part int, keys binary, total binary, mine binary, docs binary"


def _counting_again(n: int, bits: int):
    """Counts of a wide range, of many packs together, to those of the ``n`` narrow ones."""

    def run(batches):
        for rows in _runs_of(batches, ["part", "keys", "total", "mine", "docs"]):
            key, *counts = (np.concatenate([f(r[c]) for r in rows]) for c, f in ((1, _keys), (2, unplanes), (3, unplanes), (4, unplanes)))
            order = np.argsort(key, kind="stable")
            at = _firsts(key[order])
            key, counts = key[order][at], [np.add.reduceat(c[order], at) for c in counts]
            out = [(r, planes(np.diff(key[a:b], prepend=np.uint64(0))), *(planes(c[a:b]) for c in counts)) for r, a, b in _ranges(key, n, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["part", "keys", "total", "mine", "docs"])

    return run


def _bundling(n: int, bits: int):
    """What packs have in a wide range, put together into bundles (numbered under 0), to the ``n`` narrow ranges.

    A bundle's own row has in ``ids`` its packs and how many documents each has, in ``count`` their places in the packs.
    """
    names = ["part", "keys", "docs", "doc", "count", "ids", "marks", "pack"]

    def run(batches):
        bundle = -1 - (TaskContext.get().partitionId() << 32)
        for rows in _runs_of(batches, names):
            if rows[0][0] < 0:
                out = rows
            else:
                places = [unplanes(r[5]) for r in rows]
                size = np.array([len(p) for p in places], np.int64)
                marks = np.concatenate([np.unpackbits(np.frombuffer(r[6], np.uint8), count=k) for r, k in zip(rows, size.tolist(), strict=True)])
                key = np.concatenate([np.repeat(_keys(r[1]), unplanes(r[2]).astype(np.int64)) for r in rows])
                doc = np.concatenate([unplanes(r[3]).astype(np.int64) + k for r, k in zip(rows, (np.cumsum(size) - size).tolist(), strict=True)])
                count = np.concatenate([unplanes(r[4]) for r in rows])
                order = np.argsort(key, kind="stable")
                key, doc, count = key[order], doc[order], count[order]
                own = np.array([len(rows), *[r[7] for r in rows], *size], np.int64)
                out = [(-1 - (-bundle) % n, b"", b"", b"", planes(np.concatenate(places)), own.tobytes(), b"", bundle), *_dealt(key, doc, count, marks, n, bits, bundle)]
                bundle -= 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 6, pa.int64()], strict=True)], names=names)

    return run


def _unbundled(key, group):
    """A bundle's sums to those of its packs; a pack's own row stays."""
    bundle = key[0].as_py()
    if bundle >= 0:
        return group.select(["pack", "ids", "t", "b"])
    own, t, b = _summed_places(group)
    n = int(own[0][0])
    packs, size = own[0][1 : n + 1], own[0][n + 1 :]
    end = np.cumsum(size)
    out = [(p, planes(own[1][e - k : e]), signed_planes(t[e - k : e]), signed_planes(b[e - k : e])) for p, k, e in zip(packs.tolist(), size.tolist(), end.tolist(), strict=True)]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["pack", "ids", "t", "b"])


def _summed_places(group) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Of a pack or bundle its own row, and the sums of each of its documents."""
    own, rows = None, []
    for x, t, b in zip(*(group[c].to_pylist() for c in ("ids", "t", "b")), strict=True):
        if b is None:
            own = np.frombuffer(x, np.int64), unplanes(t).astype(np.int64)
        else:
            rows.append((unplanes(x).astype(np.int64), signed_unplanes(t), signed_unplanes(b)))
    out = np.zeros((2, len(own[1])), np.int64)
    for at, t, b in rows:
        out[0, at] += t
        out[1, at] += b
    return own, out[0], out[1]


def _joined(key, group):
    """A pack's documents, their tokens and their losses a token: as much as the pack's own keys at most."""
    (ids, tokens), t, b = _summed_places(group)
    loss = np.round(np.stack([t, b]) / 1e9 / tokens, 9)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == _NONE), "n_tokens": tokens, "target_loss": loss[0], "background_loss": loss[1], "score": np.round(loss[0] - loss[1], 9)})


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference; lower is nearer the target.

    ``target`` (doc_id) names the target documents; unknown, null and repeated ids in it do nothing. Tokens are words,
    runs without ASCII white space, A-Z in lower case, and an end sign; null and empty texts have the end sign only.
    Each row is a document: rows of one doc_id, or without one, are scored each for itself, the others being a part of
    the rest. Without target documents the score is the background's loss against a uniform model. Other columns are
    left out; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "lm") as s:
        return materialize(_scored(docs, target, s), "scores")


def _scored(docs: DataFrame, target: DataFrame, s: Scratch) -> DataFrame:
    spark = docs.sparkSession
    ids = target.where("doc_id IS NOT NULL").select("doc_id").distinct()
    shared = None
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        shared = spark.sparkContext.broadcast(np.sort(ids.toArrow()["doc_id"].to_numpy()))  # sorted once
        rows = docs.select("doc_id", "text", F.lit(False).alias("marked"))
    else:
        marked = ids.withColumn("m", F.lit(True)).hint("shuffle_hash")
        rows = s.write(docs.select("doc_id", "text").join(marked, "doc_id", "left").select("doc_id", "text", F.coalesce("m", F.lit(False)).alias("marked")), "marked")
    whole = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(8, -(-whole // RANGE_BYTES))
    narrow = -(-n // FAN)  # ranges within each of those that packs are dealt out over
    wide = -(-n // narrow)
    n = wide * narrow
    bits = min(63, max(32, whole.bit_length()) + KEY_BITS)
    tasks = min(MOST_TASKS, max(2 * n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.lit(max(1, narrow * RANGE_BYTES // BUNDLE_BYTES))
    counted = rows.mapInArrow(_counting(wide, bits, shared), _COUNTED)
    if narrow > 1:
        counted = counted.repartition(tasks, "part", F.pmod(F.xxhash64("keys"), salts)).sortWithinPartitions("part").mapInArrow(_counting_again(n, bits), _COUNTED)
    model = counted.repartition(tasks, "part").groupBy("part").applyInArrow(_summed, "part int, keys binary, total binary, mine binary, words long, postings long")
    model = s.write(model, "ngrams")
    vocabulary = (model.agg(F.sum("words").alias("w")).first()["w"] or 0) + 1
    # Shares of a range: one, but for ranges with a key of very many documents.
    shares = F.ceil(F.col("postings") / MEET).cast("int")
    split = model.where(F.col("postings") > MEET).select("part", shares.alias("shares"))
    dealt = rows.mapInArrow(_dealing(wide, bits, shared), _DEALT)
    if narrow > 1:  # in order of pack, so that a task that is run again makes the same bundles
        dealt = dealt.repartition(tasks, "part", F.pmod(F.xxhash64("pack"), salts)).sortWithinPartitions("part", "pack").mapInArrow(_bundling(n, bits), _DEALT)
    hot = split.limit(BROADCAST_IDS + 1).count()
    if not hot:
        dealt, entries = dealt.withColumn("share", F.lit(0)), model.withColumn("share", F.lit(0))
    else:
        dealt = dealt.join(F.broadcast(split) if hot <= BROADCAST_IDS else split, "part", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("pack"), F.col("shares")).cast("int"), F.lit(0)))
        entries = model.withColumn("share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    keys = ["part", "share"]
    entries = entries.select(*keys, "keys", "total", "mine").repartition(tasks, *keys)
    met = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(_losses(vocabulary), _MET)
    if narrow > 1:
        met = met.repartition(tasks, "pack").groupBy("pack").applyInArrow(_unbundled, _MET)
    return met.repartition(tasks, "pack").groupBy("pack").applyInArrow(_joined, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


_MET = "pack long, ids binary, t binary, b binary"
