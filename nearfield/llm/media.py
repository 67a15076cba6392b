"""Media columns: WAV bytes, short-time spectra and fingerprints of spectral-peak pairs."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.base import map_batches, utf8

#: Samples of a frame and between frames, frames transformed at once, peaks that an anchor is paired with and their farthest distance in frames.
FRAME, HOP, BLOCK, FAN, REACH = 576, 288, 1024, 3, 7
#: First bins of the frequency bands; each gives a frame one peak.
BANDS = (2, 24, 96, 289)
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, rate, 0, "NONE", "NONE"))
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak, in order of time, then frequency.

    A band's strongest bin is a peak where no neighbouring frame has the same bin stronger. The whole signal is
    transformed, a block of frames at a time with one frame more on either side.
    """
    x = np.frombuffer(samples, np.uint8)
    if len(x) < FRAME:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    n, times, bins = len(frames), [], []
    for i in range(0, n, BLOCK):
        lo, hi = max(0, i - 1), min(n, i + BLOCK + 1)
        f = np.fft.rfft((frames[lo:hi].astype(np.float32) - np.float32(128)) * _WINDOW)
        power = np.square(f.real) + np.square(f.imag)
        own = np.arange(i - lo, min(n, i + BLOCK) - lo)
        for a, b in zip(BANDS[:-1], BANDS[1:], strict=True):
            k = a + power[own, a:b].argmax(1)
            p = power[own, k]
            ok = (p > 0) & (p >= power[np.maximum(own - 1, 0), k]) & (p >= power[np.minimum(own + 1, len(power) - 1), k])
            times.append(own[ok] + lo)
            bins.append(k[ok])
    t, k = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((k, t))
    return t[order], k[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Anchor frame and code (bin, later bin, distance) of each pair of near peaks."""
    t, k = peaks(samples)
    at, code = [], []
    for step in range(1, FAN + 1):
        d = t[step:] - t[:-step]
        near = d <= REACH
        at.append(t[:-step][near])
        code.append((k[:-step] << 16 | k[step:] << 4 | d)[near])
    at, code = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((code, at))
    return at[order].astype(np.int32), code[order].astype(np.int32)


def sound_columns(docs: DataFrame, pad: int = 576, media: bool = False) -> DataFrame:
    """Texts as sound, read back and fingerprinted.

    The text's UTF-8 bytes (null: none) are padded with 255 to a positive multiple of ``pad`` and stored as samples.
    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, the
    time-coded arrays peak_frames and peak_codes, and with ``media`` the WAV itself. Repeated rows and equal texts
    give equal values; other columns are left out.
    """

    def one(data: bytes):
        stored = to_wav(data + b"\xff" * (pad - len(data) % pad if len(data) % pad or not data else 0))
        back = from_wav(stored)
        at, code = fingerprint(back)
        feature = f"{len(at)}:{hashlib.sha256(at.tobytes() + code.tobytes()).hexdigest()}"
        return (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, at, code, stored)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()][: 9 + media]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_frames", "peak_codes", "media"][: 10 + media]

    def make():
        def run(b: pa.RecordBatch):
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [one(x)[: 9 + media] for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

        return run

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_frames array<int>, peak_codes array<int>" + ", media binary" * media
    return map_batches(docs.select("doc_id", "text"), make, schema)
