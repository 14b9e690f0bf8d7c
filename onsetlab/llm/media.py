"""Operator 5: media columns of sound.

A text's bytes, padded with zeros to a positive multiple of 64, are stored as a mono WAV
file of 8-bit samples and read back by the ``wave`` module. Features: a short-time Fourier
transform (Hann window, frames that overlap by half, silence of half a frame before the
first sample and after the last, so that every byte weighs the same), in each frame the
strongest bin of each band that stands above the frame's mean without its bin 0, and pairs
of such peaks in one frame or close in time. A pair's hash has both bins, their distance
and, within a frame, the ratio of their strengths in steps of ``1 / LEVELS`` octave; the
fingerprint is the array of (time, hash), in order of time. A time is the frame's begin in
lengths of a frame, so in steps of one half.

Transform and pairs go through the samples in blocks, so what a very long text takes besides its
samples is about as much again (1.9 times them at 4 MB). ``media_columns`` has the arrays as columns;
they are some 4.5 times the text (0.28 pairs a byte of sf0.1, 16 bytes each), so the registered
query returns their digest and length in their place.

Defined cases: null and empty text are 64 zero bytes; repeated rows give a row each, and
equal texts equal values; a null id is passed through; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from onsetlab.llm.common import map_rows, texts

UNIT = 64
RATE = 8000
FRAME, HOP = 512, 256
#: Edges of the bands in bins; a frame's peak is sought in each.
BANDS = (1, 8, 16, 32, 64, 128, 256)
#: A peak is paired with peaks of its own and so many following frames.
AHEAD = 6
#: Steps an octave of the ratio of two strengths, and the largest number of steps.
LEVELS, MOST_LEVEL = 4096, 65535
BLOCK_FRAMES = 512
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long"


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    short = -len(raw) % UNIT if raw else UNIT
    return raw + b"\0" * short, len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(1)
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin by (frame, band), 0 where none stands above the frame's mean, and its
    strength in steps of 1 / LEVELS octave."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) // HOP) + 1
    out = np.zeros((n, len(BANDS) - 1), np.int32)
    level = np.zeros((n, len(BANDS) - 1), np.int32)
    for at in range(0, n, BLOCK_FRAMES):
        k = min(BLOCK_FRAMES, n - at)
        part = np.full((k - 1) * HOP + FRAME, 128, np.uint8)
        begin = at * HOP - HOP  # of the first frame, in samples
        have = x[max(0, begin) : begin + len(part)]
        part[max(0, -begin) :][: len(have)] = have
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft((frames.astype(np.float32) - 128.0) * _window(), axis=1))
        mean = power[:, BANDS[0] : BANDS[-1]].mean(axis=1)
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            best = power[:, low:high].argmax(axis=1) + low
            strength = power[np.arange(k), best]
            out[at : at + k, b] = np.where(strength > mean, best, 0)
            level[at : at + k, b] = np.rint(LEVELS * np.log2(np.maximum(strength, 1e-6)))
    return out, level


@lru_cache(1)
def _pairs() -> np.ndarray:
    """Frames ahead, band and other band of the pairs sought: all bands of a frame with each
    other, and each band with itself and one other in each following frame."""
    n = len(BANDS) - 1
    within = [(0, a, b) for a in range(n) for b in range(a + 1, n)]
    return np.array(within + [(d, a, b) for d in range(1, AHEAD + 1) for a in range(n) for b in sorted({a, (a + d) % n})]).T


def fingerprint_blocks(samples: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Times (begin of a frame, in frames) and hashes of peak pairs, ordered by both; pairs are
    formed for BLOCK_FRAMES frames at a time, with the frames ahead that they reach."""
    p, level = peaks(samples)
    ahead, band, other = _pairs()
    for at in range(0, len(p), BLOCK_FRAMES):
        own, strong = p[at : at + BLOCK_FRAMES], level[at : at + BLOCK_FRAMES]
        near = p[at : at + BLOCK_FRAMES + AHEAD]
        near = np.concatenate([near, np.zeros((len(own) + AHEAD - len(near), p.shape[1]), p.dtype)])
        b = near[np.arange(len(own))[:, None] + ahead, other]
        t, k = np.nonzero((own[:, band] > 0) & (b > 0))
        h = own[t, band[k]].astype(np.int64) << 20 | b[t, k].astype(np.int64) << 8 | ahead[k]
        ratio = np.clip(strong[t, band[k]] - strong[t, other[k]], -MOST_LEVEL, MOST_LEVEL)
        h |= np.where(ahead[k] == 0, ratio + MOST_LEVEL + 1, 0).astype(np.int64) << 32
        order = np.lexsort((h, t))
        yield (at + t[order] - 1) * (HOP / FRAME), h[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All times and hashes as two arrays."""
    times, hashes = zip(*fingerprint_blocks(samples))
    return np.concatenate(times), np.concatenate(hashes)


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, wav (binary), and the time-coded arrays frame_at and pair_hash."""

    def make():
        def rows(c):
            for i, text in zip(*c):
                stored = to_wav(payload(text)[0])
                t, h = fingerprint(from_wav(stored))
                yield i, stored, t.tolist(), h.tolist()

        return rows

    return map_rows(texts(docs), make, "doc_id long, wav binary, frame_at array<double>, pair_hash array<long>")


def media_digests(docs: DataFrame) -> DataFrame:
    """As media_columns, with digests in place of the stored form and the arrays. No shuffle."""

    def make():
        def rows(c):
            for i, text in zip(*c):
                samples, n = payload(text)
                stored = to_wav(samples)
                back = from_wav(stored)
                digest, n_pairs = hashlib.sha256(), 0
                for t, h in fingerprint_blocks(back):
                    digest.update(np.stack([t * (FRAME // HOP), h], axis=1).astype("<i8").tobytes())
                    n_pairs += len(t)
                yield (
                    i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored),
                    hashlib.sha256(stored).hexdigest(), f"{n_pairs}:{digest.hexdigest()[:32]}", n_pairs,
                )

        return rows

    return map_rows(texts(docs), make, SCHEMA)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
