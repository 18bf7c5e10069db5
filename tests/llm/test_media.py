"""WAV round trips, peaks and pairs against plain loops."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np

from lineweave.llm import media as M


def slow_peaks(samples):
    x = np.frombuffer(samples, dtype=np.uint8).astype(float) - 128
    out = []
    for t in range((len(x) - M.FRAME) // M.HOP + 1):
        m = np.rint(np.abs(np.fft.rfft(x[t * M.HOP : t * M.HOP + M.FRAME] * M._WINDOW)) * 1024).astype(int).tolist()
        peaks = [k for k in range(1, len(m) - 1) if m[k] > m[k - 1] and m[k] >= m[k + 1]]
        out += [(t, k) for k in sorted(sorted(peaks, key=lambda k: (-m[k], k))[: M.PEAKS])]
    return out


def slow_pairs(peaks):
    out = []
    for i, (t, k) in enumerate(peaks):
        after = [(u, j) for u, j in peaks[i + 1 :] if 1 <= u - t <= M.REACH][: M.FAN]
        out += [(t << 32) | (k << 20) | (j << 8) | (u - t) for u, j in after]
    return sorted(out)


def test_features(monkeypatch):
    monkeypatch.setattr(M, "_SLAB", 7)
    rng = random.Random(1)
    for n in (0, 1, 192, 193, 5000):
        payload, size = M.payload_of("".join(rng.choice("abc deéf") for _ in range(n)))
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload[size:] == b" " * (len(payload) - size)
        assert M.samples_of(M.wav_bytes(payload)) == payload
        peaks = M.spectral_peaks(payload)
        assert [tuple(p) for p in peaks.tolist()] == slow_peaks(payload)
        assert M.pairs_of(peaks).tolist() == slow_pairs(slow_peaks(payload))


def test_pairs_reach_all_frames():
    rng = random.Random(2)
    peaks = M.spectral_peaks(M.payload_of("".join(rng.choice("abc deéf") for _ in range(4000)))[0])
    want = sorted((t << 32) | (k << 20) | (j << 8) | (u - t) for t, k in peaks.tolist() for u, j in peaks.tolist() if 1 <= u - t <= M.REACH)
    got = M.pairs_of(peaks).tolist()
    assert got == want and {p & 255 for p in got} == set(range(1, M.REACH + 1))


def test_columns(spark):
    texts = ["héllo " * 100, None, "", "x" * 192, "x" * 100_000, "héllo " * 100]
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    wav = {r.id: bytes(r.media) for r in M.to_wav(docs).collect()}
    got = {r.doc_id: r for r in M.digests(M.peak_pairs(M.to_wav(docs))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        with wave.open(io.BytesIO(wav[i])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(wav[i]), hashlib.sha256(wav[i]).hexdigest())
        pairs = slow_pairs(slow_peaks(payload)) if len(payload) < 10_000 else None
        if pairs is not None:
            assert r.feature == f"{(len(payload) - 192) // 96 + 1}:{len(pairs)}:{hashlib.sha256(','.join(map(str, pairs)).encode()).hexdigest()}"
    assert got[0].feature == got[5].feature and got[1].feature == got[2].feature
    assert M.peak_pairs(M.to_wav(docs.limit(0))).count() == 0
