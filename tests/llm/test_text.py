"""Byte-level BPE, packing, media columns, sharding."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import same

from nearfield.llm import bpe, media, packing, queries, sharding
from nearfield.llm.vocab import Pieces, file_pattern, file_tokenizer, read_ranks

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "  a\n \n b ", "naïve 漢字🙂 <|endoftext|>", "J̌İΣÉ́", "x" * 5000, "word " * 6000, "\x1c\x85\xa0 1²3", "'s 'S it's"]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "extra", -1) for i, t in enumerate(rows)], "doc_id long, text string, ids string, n_tokens long")


def test_bpe_is_tiktoken(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rnd = random.Random(1)
    rows = ODD + ["".join(rnd.choice("ab c \n\t'sré漢1²🙂!?.") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    got = {r["doc_id"]: r for r in bpe.round_trip(texts(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(rows):
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        # Token by token: a character that is split belongs to each of its tokens.
        at, begun, pairs, split = 0, 0, [], 0
        chars = [len(c.encode()) for c in t or ""]
        ends = np.cumsum([0, *chars]).tolist()
        for x in ids:
            first = next(k for k in range(begun, len(chars)) if ends[k + 1] > at)
            at, begun = at + len(enc.decode_single_token_bytes(x)), first
            last = next(k for k in range(first, len(chars) + 1) if ends[k] >= at)
            split += ends[last] != at
            pairs += [first, last]
        assert got[i]["offsets_sha256"] == hashlib.sha256(struct.pack(f"<{len(pairs)}i", *pairs)).hexdigest() and got[i]["n_split"] == split


def test_bpe_offsets_and_split_characters(spark):
    own = bpe.ByteBPE.get(RANKS, public_tokenizers.PATTERN)
    for t in ("héllo 漢字🙂x", "🙂🙂", "abc"):
        ids = own.encode([t])[0]
        parts = own.decode(ids)
        assert "".join(parts) == t and len(parts) == len(ids)
        at = own.offsets(t, ids)
        assert at[0, 0] == 0 and at[-1, 1] == len(t) and (at[:, 0] < at[:, 1]).all()
    df = bpe.encode(texts(spark, ["ab 漢", None]), RANKS, public_tokenizers.PATTERN, offsets=True)
    back = bpe.decode(df, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["data"]) for r in back] == ["ab 漢".encode(), b""]
    assert own.decode(np.array([own.encode(["🙂"])[0][0]])) == ["�"]


def test_bpe_of_no_rows(spark):
    assert bpe.round_trip(texts(spark, ["x"]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def unpacked(spark, rows):
    """Checks what holds of any packing; returns its pieces."""
    t = file_tokenizer(WORDS)
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in rows]
    out = packing.pack_documents(texts(spark, rows), WORDS).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, ids in enumerate(want):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0
    return out


def test_packing_keeps_every_id_once(spark):
    rnd = random.Random(2)
    unpacked(spark, ODD + ["Ab c, " * rnd.randint(1, 900) for _ in range(60)])


def test_packing_windows(spark, monkeypatch):
    rows = ["ab cd " * (k * 37 % 500) for k in range(80)]
    assert unpacked(spark, rows)
    monkeypatch.setattr(packing, "WINDOW_TOKENS", 1)
    packed = list(packing.pack([packing.Segment(i, 0, 100 * i) for i in range(1, 60)], packing.Limits())[0])
    assert all(sum(s.length for s in b) == 4096 for b in packed)


def test_vector_limits_hold():
    limits = packing.Limits(tokens=100, segments=3, loss=40)
    items = [packing.Segment(i, 0, 10 + i % 50, prompt=i % 30) for i in range(200)]
    bins, rest = packing.pack(items, limits)
    for b in [*bins, rest]:
        assert sum(s.length for s in b) <= 100 and len(b) <= 3 and sum(s.loss for s in b) <= 40
    whole: dict[int, int] = {}
    for s in [s for b in [*bins, rest] for s in b]:
        whole[s.of] = whole.get(s.of, 0) + s.length
    assert whole == {s.of: s.length for s in items}
    uncut = packing.pack([packing.Segment(0, 0, 60), packing.Segment(1, 0, 60)], packing.Limits(100, 3, 100), cut=False)
    assert [len(b) for b in [*uncut[0], uncut[1]]] == [1, 1]
    with pytest.raises(ValueError):
        packing.pack([packing.Segment(0, 0, 101)], limits, cut=False)
    assert packing.pack([packing.Segment(0, 0, 0)], limits) == ([], [])


def test_plain_pieces_are_the_tokenizers(spark):
    rnd = random.Random(3)
    p, t = Pieces(file_tokenizer(WORDS), file_pattern(WORDS), lower=True), file_tokenizer(WORDS)
    rows = ["".join(rnd.choice("abé É'sJ̌İΣ1²½_,.!漢\x1c\x85\t") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    special = ["a <|endoftext|> b", "x<|startoftext|>y<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "漢 <|endoftext|>é É", "<|endoftext|>", " <|start<|startoftext|>"]
    assert t.encode(special[0], add_special_tokens=False).ids == [320, 49407, 321]
    rows += special + [rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|", "a ", "é", "漢"]) * rnd.randint(1, 3) + r for r in rows[:300]]
    for way in (p.encode_texts(rows, packing._words), p.encode([r.encode().split() for r in rows])):
        for row, ids in zip(rows, way, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(row, add_special_tokens=False).ids


def plain_pack(items, limits):
    """Bins of (of, start, length), by the rules written out: of what fits, the largest dot product of demand and room."""
    left = []
    bins = []
    for s in items:
        while s.length > limits.tokens or s.loss > limits.loss:
            n = max(k for k in range(1, s.length + 1) if k <= limits.tokens and s.head(k).loss <= limits.loss)
            bins.append([s.head(n)])
            s = s.tail(n)
        left.append(s)
    now, t, l = [], limits.tokens, limits.loss  # noqa: E741
    while left:
        if not t or len(now) == limits.segments:
            bins.append(now)
            now, t, l = [], limits.tokens, limits.loss  # noqa: E741
        fit = [s for s in left if s.length <= t and s.loss <= l]
        gain = lambda s: s.length / limits.tokens * (t / limits.tokens) + s.loss / limits.loss * (l / limits.loss)  # noqa: E731,B023
        if fit:
            best = max(map(gain, fit))
            kind = min((s.length, s.loss) for s in fit if gain(s) == best)
            s = [s for s in left if (s.length, s.loss) == kind][-1]
            left.remove(s)
        else:
            kind = min((s.length, s.loss) for s in left)
            s = [s for s in left if (s.length, s.loss) == kind][-1]
            n = max([k for k in range(1, s.length + 1) if k <= t and s.head(k).loss <= l], default=0)
            if not n:
                bins.append(now)
                now, t, l = [], limits.tokens, limits.loss  # noqa: E741
                continue
            left.remove(s)
            left.append(s.tail(n))
            s = s.head(n)
        now.append(s)
        t, l = t - s.length, l - s.loss  # noqa: E741
    return [[(s.of, s.start, s.length) for s in b] for b in [*bins, now] if b]


@pytest.mark.parametrize("limits", [packing.Limits(100, 5, 40), packing.Limits(64, 3, 64), packing.Limits(50, 9, 7)])
def test_packing_is_the_plain_choice(limits):
    rnd = random.Random(11)
    for _ in range(30):
        items = [packing.Segment(i, 0, n, rnd.randint(0, n)) for i, n in enumerate(rnd.choices(range(1, 130), k=40))]
        bins, rest = packing.pack(items, limits)
        assert [[(s.of, s.start, s.length) for s in b] for b in [*bins, rest] if b] == plain_pack(items, limits)


def test_instructions_are_packed_under_all_limits(spark):
    rnd = random.Random(12)
    rows = [(c, t, ("user", "assistant")[t % 2], f"w{c} " * rnd.randint(0, 90)) for c in range(1, 81) for t in range(4)]
    rows += [(3, 1, "assistant", "again"), (3, 0, "user", "a later one"), (None, 1, "assistant", None), (7, None, "assistant", "no turn"), (99, 5, "assistant", "alone"), (98, 1, None, "x")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "conv_id long, turn int, role string, text string, start int, prompt string").repartition(3)
    pairs = packing.instructions(df)
    said = sorted((r["conv_id"] or -1, r["turn"] or -1, r["prompt"], r["response"]) for r in pairs.collect())
    text = {(c, t): x for c, t, _, x in reversed(rows[:320])} | {(3, 0): min(rows[8][3], "a later one")}
    assert said == sorted((c or -1, t or -1, text.get((c, (t or 0) - 1), "") if t else "", x or "") for c, t, r, x in rows if r == "assistant")
    limits, t = packing.Limits(256, 4, 96), file_tokenizer(WORDS)
    out = packing.pack_instructions(pairs, WORDS, ["conv_id", "turn"], limits=limits).collect()
    by_seq, by_row = {}, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_row.setdefault((r["conv_id"] or -1, r["turn"] or -1), []).append(r)
    for parts in by_seq.values():
        assert sum(r["length"] for r in parts) <= 256 and len(parts) <= 4 and sum(r["loss_tokens"] for r in parts) <= 96
        assert [r["offset"] for r in sorted(parts, key=lambda r: r["offset"])] == np.cumsum([0, *[r["length"] for r in sorted(parts, key=lambda r: r["offset"])]]).tolist()[:-1]
    tokens = lambda x: t.encode(x, add_special_tokens=False).ids
    for c, turn, p, x in said:
        ids, n = [*tokens(p), *tokens(x), 2], len(tokens(p))
        if (c, turn) != (3, 1):
            parts = sorted(by_row[c, turn], key=lambda r: r["start"])
            assert sum(r["length"] for r in parts) == len(ids) == parts[0]["example_tokens"] and parts[0]["prompt_tokens"] == n
            for r in parts:
                assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
                assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], n))
    assert packing.pack_instructions(pairs.limit(0), WORDS, ["conv_id", "turn"]).count() == 0


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (4, None), (None, None)], "doc_id long, text string")
    out = packing.pack_documents(df.withColumn("length", df.doc_id), WORDS).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in out if r["start"] == 0) == [(-1, 1), (-1, 3), (4, 1), (4, 3), (4, 3)]
    assert sum(r["length"] for r in out) == 11
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def test_media_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    out = media.sound_columns(df.withColumn("feature", df.text)).collect()
    assert len(out) == 3 and len({r["media_sha256"] for r in out}) == 1
    assert media.sound_columns(df.limit(0)).count() == 0


def plain_fingerprint(samples):
    """Peaks and pairs by the discrete Fourier sum of each frame, one number at a time where it matters."""
    frames = [samples[i : i + media.FRAME] for i in range(0, len(samples) - media.FRAME + 1, media.HOP)]
    n = media.FRAME
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)]
    turn = np.exp(-2j * np.pi * np.arange(n)[None] * np.arange(n // 2 + 1)[:, None] / n)
    power = [abs(turn @ np.array([(s - 128) * w for s, w in zip(f, window, strict=True)])) ** 2 for f in frames]
    peaks = []
    for t, p in enumerate(power):
        for a, b in zip(media.BANDS[:-1], media.BANDS[1:], strict=True):
            k = max(range(a, b), key=lambda j: (p[j], -j))  # noqa: B023
            if p[k] > 0 and all(p[k] >= power[u][k] for u in (t - 1, t + 1) if 0 <= u < len(power)):
                peaks.append((t, k))
    peaks.sort()
    return sorted((t, k << 16 | j << 4 | u - t) for i, (t, k) in enumerate(peaks) for u, j in peaks[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)


def test_fingerprint_is_the_plain_one():
    noise = np.random.default_rng(3).integers(0, 256, 576 * 12, dtype=np.uint8).tobytes()
    text = ("The quick brown fox, and more of it. " * 200).encode()[: 576 * 10]
    for samples in (noise, noise[:576], b"a" * 575, text + noise[:577]):
        at, code = media.fingerprint(samples)
        assert list(zip(at.tolist(), code.tolist(), strict=True)) == plain_fingerprint(samples)


def test_media(spark):
    rows = ["", None, "abc", "x" * 576, "wave " * 5000, "wave " * 5000]
    got = {r["doc_id"]: r for r in media.sound_columns(texts(spark, rows), media=True).collect()}
    for i, t in enumerate(rows):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and media.from_wav(bytes(r["media"])) == payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(bytes(r["media"])).hexdigest())
    assert got[4]["feature"] == got[5]["feature"] != got[3]["feature"] and len(got[4]["peak_codes"]) > 100


def test_peaks_of_a_tone_and_blocks(monkeypatch):
    x = (128 + 100 * np.sin(2 * np.pi * 60 * np.arange(576 * 40) / 576)).astype(np.uint8).tobytes()
    t, k = media.peaks(x)
    assert (k == 60).sum() > 20 and (np.diff(t) >= 0).all()
    noise = np.random.default_rng(1).integers(0, 256, 576 * 60, dtype=np.uint8).tobytes()
    whole = media.fingerprint(noise)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(noise), strict=True))


def test_shards_are_the_sql(spark):
    same(queries.QUERIES["op5_sharding"](spark, SF), queries.ORACLE_SQL["op5_sharding"], SF)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a"), (None, "a"), (5, ""), (5, "é"), (5, "é"), (2, "x" * 9000)], [(i * i, "y" * (i % 7)) for i in range(500)]])
def test_shards_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, size int, shard int")
    out = sharding.byte_shards(df, 4).collect()
    line = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in out)
    assert len(line) == len(rows) and [x[4] for x in line] == sorted(x[4] for x in line)
    upto, whole, slots = 0, sum(x[3] for x in line), {}
    for *_, size, shard, slot in line:
        assert shard == (2 * upto + size) * 4 // (2 * whole) and slot == slots.get(shard, 0)
        slots[shard] = slot + 1
        upto += size
