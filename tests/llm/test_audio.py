"""Media columns against plain versions: bytes by struct, signal processing by definition in double precision."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa

from inkfold.llm import audio


def plain_resample(x, taps=8, up=3, down=4):
    """Zeros between the samples, one long low pass, every fourth value."""
    n = up * taps
    h = [math.sin(math.pi * t / 4) / (math.pi * t / 4) if t else 1.0 for t in (i - (n - 1) / 2 for i in range(n))]
    h = [v * (0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(h)]
    h = [up * v / sum(h) for v in h]
    stuffed = [0.0] * (up * len(x))
    stuffed[::up] = list(x)
    return [sum(h[k] * stuffed[i - k] for k in range(n) if 0 <= i - k < len(stuffed)) for i in range(0, len(stuffed), down)]


def plain_log_mel(y, rate=12_000, size=256, hop=128, mels=32):
    n = max(1, math.ceil((len(y) - size) / hop) + 1)
    y = np.array([*y, *[0.0] * ((n - 1) * hop + size - len(y))])
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    to_mel, to_hz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = [to_hz(to_mel(rate / 2) * i / (mels + 1)) for i in range(mels + 2)]
    bank = np.zeros((size // 2 + 1, mels))
    for i in range(size // 2 + 1):
        f = i * rate / size
        for m in range(mels):
            low, mid, high = edges[m : m + 3]
            bank[i, m] = (f - low) / (mid - low) if low <= f <= mid else (high - f) / (high - mid) if mid < f <= high else 0.0
    mel, energy = [], []
    for at in range(0, n * hop, hop):
        frame = y[at : at + size]
        power = np.abs(turn @ (frame * window)) ** 2
        mel.append(np.log10(power @ bank + 1e-10))
        energy.append(10 * math.log10((frame**2).mean() + 1e-10))
    return np.array(mel), energy


def plain_segments(energy):
    """Open above the low threshold, keep the run if it came above the high one."""
    ranked = sorted(energy)
    at = 0.1 * (len(ranked) - 1)
    floor = ranked[int(at)] + (at % 1) * (ranked[min(int(at) + 1, len(ranked) - 1)] - ranked[int(at)])
    low, high = (floor + k * (max(energy) - floor) for k in (0.4, 0.6))
    out, start, reached = [], None, False
    for i, e in enumerate([*energy, -math.inf]):
        if e >= low and start is None:
            start, reached = i, False
        if start is not None:
            reached |= e >= high
            if e < low:
                out += [[start, i]] * reached
                start = None
    return out


TEXTS = [None, "", "a", "é" * 31 + "xx", "long text of many words, " * 900, "a", "loud WORDS\n" * 60 + " " * 3000 + "quiet"]


def payload(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


def test_media(spark):
    docs = spark.createDataFrame([(i, t, b"x", "f", 1) for i, t in enumerate(TEXTS)] + [(None, "a", b"x", "f", 1), (2, "a", b"y", "f", 1)], "doc_id long, text string, media binary, feature string, n_bytes int")
    for r in audio.text_media(docs).collect():
        if r.doc_id is not None:
            data = payload(TEXTS[r.doc_id])
            assert bytes(r.media) == b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, audio.RATE, audio.RATE, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
            assert r.n_bytes == len((TEXTS[r.doc_id] or "").encode())
    got = audio.media_digest(docs).collect()
    assert len(got) == len(TEXTS) + 2 and len({tuple(map(str, r[1:])) for r in got if r.n_bytes == 1}) == 1
    for r in got:
        data = payload("a" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r.media_bytes == len(data) + 44
    assert audio.media_digest(docs.limit(0)).collect() == []
    assert audio.audio_features(docs.selectExpr("doc_id", "1L as n_bytes", "cast(null as binary) as media").limit(1)).first().feature is None


def test_features_by_definition(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in audio.media_digest(docs).collect():
        x = [(b - 128) / 128 for b in payload(TEXTS[r.doc_id])]
        mel, energy = plain_log_mel(plain_resample(x))
        spans = plain_segments(energy)
        assert r.n_frames == len(mel) == sum(t.frames for t in r.tensors)
        assert [(round(s.start_s * 12_000), round(s.end_s * 12_000)) for s in r.segments] == [(a * 128, (b - 1) * 128 + 256) for a, b in spans]
        cubes = audio.as_tensors(pa.array([bytes(t.log_mel) for t in r.tensors], pa.binary()))
        assert cubes.type == pa.fixed_shape_tensor(pa.float16(), audio.TENSOR_SHAPE)
        held = cubes.to_numpy_ndarray()
        for k, t in enumerate(r.tensors):
            assert np.allclose(held[k, : t.frames], mel[64 * k : 64 * k + t.frames], atol=0.02) and not held[k, t.frames :].any()
            assert round(t.start_s * 12_000) == 64 * k * 128 and round(t.end_s * 12_000) == (64 * k + t.frames - 1) * 128 + 256
        facts = dict(x.split("=") for x in r.feature.split(";"))
        assert (int(facts["frames"]), int(facts["segments"]), int(facts["active"])) == (len(mel), len(spans), sum(b - a for a, b in spans))
        assert np.allclose([float(v) for v in facts["mel"].split(",")], mel.mean(0), atol=0.011) and abs(float(facts["spread"]) - mel.std(0).mean()) < 0.011


def test_tone():
    t = np.arange(16_000) / audio.RATE
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 12_000
    spectrum = np.abs(np.fft.rfft(y[1000:11_000]))
    assert abs(spectrum.argmax() * audio.OUT_RATE / 10_000 - 440) < 2
    energy = np.array([0, 5, 9, 5, 5, 0, 5, 0, 10.0])
    assert audio.segments(energy).tolist() == [[1, 5], [8, 9]] == plain_segments(energy.tolist())
