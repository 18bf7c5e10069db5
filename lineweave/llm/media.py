"""Media columns: byte payloads as WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

``to_wav`` stores a payload as mono unsigned 8-bit samples in a WAV column, losslessly; ``peak_pairs`` reads such a column with
the wave module and takes features from what it reads.

Features: frames of ``FRAME`` samples, ``HOP`` apart, Hann window, magnitudes in whole numbers of 1/1024.  In a frame the
``PEAKS`` strongest local maxima over frequency are peaks (ties: the lower bin).  Each peak is paired with the peaks of the
``REACH`` frames after it, all of them.  A pair is one long: frame of the first peak, bins of
both, frames between (time << 32 | f1 << 20 | f2 << 8 | dt), and the array of a payload is in ascending order.

Transforms go over slabs of frames, so memory is fixed however long a payload is; pairs of neighbouring slabs are kept.

Edge cases: null or empty text gives one block of padding, hence one silent frame and no pairs; equal payloads have equal columns;
repeated rows are kept; an empty table gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

RATE = 8000
#: Payloads are padded with spaces to a positive multiple of this (contract).
BLOCK = 192
FRAME, HOP = 192, 96
PEAKS, REACH = 2, 3
FAN = PEAKS * REACH  # every peak in reach
_SLAB = 4096
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float64)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text padded with spaces, and its length before."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return raw.ljust(size, b" "), len(raw)


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> np.ndarray:
    """(n, 2): frame and bin of each peak, in order."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n = (len(x) - FRAME) // HOP + 1
    found = []
    for at in range(0, n, _SLAB):
        k = min(_SLAB, n - at)
        part = x[at * HOP : (at + k - 1) * HOP + FRAME].astype(np.float64) - 128.0
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW
        mags = np.rint(np.abs(np.fft.rfft(frames, axis=1)) * 1024).astype(np.int64)
        inner = mags[:, 1:-1]
        local = np.where((inner > mags[:, :-2]) & (inner >= mags[:, 2:]), inner, 0)
        # a stable order: stronger first, then the lower bin
        best = np.argmax(local, axis=1)
        rows = np.arange(k)
        for _ in range(PEAKS):
            ok = local[rows, best] > 0
            found.append(np.stack([rows[ok] + at, best[ok] + 1], axis=1))
            local[rows, best] = 0
            best = np.argmax(local, axis=1)
    peaks = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return peaks[np.lexsort((peaks[:, 1], peaks[:, 0]))]


def pairs_of(peaks: np.ndarray) -> np.ndarray:
    """Time-coded pairs, ascending."""
    frame, bin_ = peaks[:, 0], peaks[:, 1]
    n = len(frame)
    taken = np.zeros(n, dtype=np.int64)
    out = []
    for d in range(1, PEAKS * (REACH + 1)):
        if d >= n:
            break
        gap = frame[d:] - frame[:-d]
        ok = (gap >= 1) & (gap <= REACH) & (taken[:-d] < FAN)
        taken[:-d] += ok
        out.append((frame[:-d][ok] << 32) | (bin_[:-d][ok] << 20) | (bin_[d:][ok] << 8) | gap[ok])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): one WAV for each row of ``docs``."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def rows(batches):
        for b in batches:
            for i, t in zip(b["id"], b["text"]):
                payload, n = payload_of(t)
                yield i, n, wav_bytes(payload)

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, schema)


def peak_pairs(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, pairs), read from ``media``."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, pairs array<long>"
    schema = T.StructType([T.StructField("id", media.schema["id"].dataType), *T.StructType.fromDDL(fields).fields])

    def rows(batches):
        for b in batches:
            for i, n, m in zip(b["id"], b["n_bytes"], b["media"]):
                s = samples_of(m)
                yield (
                    i, n, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-16:]), len(m), hashlib.sha256(m).hexdigest(),
                    (len(s) - FRAME) // HOP + 1, pairs_of(spectral_peaks(s)),
                )

    return arrow_map(media.select("id", "n_bytes", "media"), rows, schema, batch=128)


def digests(found: DataFrame) -> DataFrame:
    """The pairs as one string: frames, pairs and the digest of the time-coded array."""
    feature = F.concat_ws(":", F.col("n_frames"), F.size("pairs"), F.sha2(F.array_join(F.col("pairs").cast("array<string>"), ","), 256))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
