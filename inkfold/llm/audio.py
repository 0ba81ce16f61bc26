"""Media columns: audio bytes, and features read from them.

A media column holds WAV bytes (8-bit PCM, mono). Features of a recording: polyphase resampling, log-mel
filterbanks over half-overlapping Hann frames, and energy segments with hysteresis (a segment is a run of frames
above the low threshold that reaches the high one), each with its time span. The log-mel frames are cut into tensors of one
fixed shape, TENSOR_SHAPE of float16, each with its time span and the number of frames that are not padding; their bytes are
a column of the result, which `as_tensors` turns into an Arrow fixed-shape tensor array without copying values one by one.

Everything is a map over rows: no shuffle, and a task holds one Arrow batch. Features are whole: no prefix
of a recording is taken. `media_digest` stores the media in the shared folder and computes from the bytes that it reads back.

Defined cases: null text is the empty payload (64 zero bytes); null media gives null features; a recording
shorter than one frame is padded with silence to one; very long texts are more tensors of the same shape; repeated rows and null ids are
rows of their own; an empty table gives an empty result; there are no ties; other columns, whatever their names, are not read by `text_media`.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Scratch

RATE, OUT_RATE = 16_000, 12_000
UP, DOWN, TAPS = 3, 4, 8
FRAME, HOP, MELS = 256, 128, 32
TENSOR_SHAPE = (64, MELS)
BLOCK = 64
FEATURES = (
    "n_samples long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, "
    "segments array<struct<start_s:double,end_s:double>>, tensors array<struct<start_s:double,end_s:double,frames:int,log_mel:binary>>"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_samples", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()),
     ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
     ("tensors", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", pa.binary())])))]
)


def _le32(n: Column) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def wav(payload: Column) -> Column:
    """WAV bytes of a column of 8-bit samples (an even number of them)."""
    n = F.octet_length(payload)
    fixed = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data")
    return F.concat(F.lit(b"RIFF"), _le32(n + 36), F.lit(b"WAVE"), F.lit(fixed), _le32(n), payload)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes as samples, zeros appended up to a positive multiple of BLOCK."""
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    pad = F.when(n == 0, BLOCK).otherwise(F.pmod(-n, F.lit(BLOCK)))
    payload = F.encode(F.concat(text, F.repeat(F.lit("\0"), pad)), "UTF-8")
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), wav(payload).alias("media"))


@cache
def _filter() -> np.ndarray:
    """Windowed-sinc low pass of UP * TAPS taps, split by phase: [UP, TAPS]."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (UP * h / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


@cache
def _mel_bank() -> np.ndarray:
    """[FRAME // 2 + 1, MELS] triangles, equally wide on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, OUT_RATE / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Rate * UP / DOWN. Output n is phase (n * DOWN) % UP of the filter at input (n * DOWN) // UP."""
    n_out, phases = -(-len(x) * UP // DOWN), _filter()
    padded = np.concatenate([np.zeros(TAPS, np.float32), x, np.zeros(DOWN * 2, np.float32)])
    y = np.empty(n_out, np.float32)
    for r in range(min(UP, n_out)):
        count, at = len(range(r, n_out, UP)), TAPS + r * DOWN // UP
        h = phases[r * DOWN % UP]
        acc = np.zeros(count, np.float32)
        for k in range(TAPS):
            acc += h[k] * padded[at - k : at - k + DOWN * (count - 1) + 1 : DOWN]
        y[r::UP] = acc
    return y


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-overlapping frames: ([frames, MELS] log10 mel power, energy in dB)."""
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    spectrum = np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32))
    power = spectrum.real**2 + spectrum.imag**2
    return np.log10(power @ _mel_bank() + 1e-10), 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + 1e-10)


def segments(energy: np.ndarray) -> np.ndarray:
    """[k, 2] frame spans: runs over the low threshold that reach the high one."""
    floor, top = np.percentile(energy, 10), energy.max()
    low = energy >= floor + 0.4 * (top - floor)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], low.astype(np.int8), [0]]))).reshape(-1, 2)
    reached = np.concatenate([[0], np.cumsum(energy >= floor + 0.6 * (top - floor))])
    return edges[reached[edges[:, 1]] > reached[edges[:, 0]]]


def tensors(mel: np.ndarray) -> list[dict]:
    """The frames in TENSOR_SHAPE pieces of float16, the last one padded with zeros."""
    rows, step, out = TENSOR_SHAPE[0], HOP / OUT_RATE, []
    for at in range(0, len(mel), rows):
        part = mel[at : at + rows]
        cube = np.zeros(TENSOR_SHAPE, "<f2")
        cube[: len(part)] = part
        out.append({"start_s": at * step, "end_s": (at + len(part) - 1) * step + FRAME / OUT_RATE, "frames": len(part), "log_mel": cube.tobytes()})
    return out


def features(media: bytes) -> dict:
    with wave.open(io.BytesIO(media)) as f:
        payload = f.readframes(f.getnframes())
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x))
    spans = segments(energy)
    step = HOP / OUT_RATE
    mean, spread = np.round(mel.mean(0), 2) + 0.0, np.round(mel.std(0).mean(), 2)
    covered = int((spans[:, 1] - spans[:, 0]).sum())
    return {
        "n_samples": len(payload), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "n_frames": len(mel), "segments": [{"start_s": a * step, "end_s": (b - 1) * step + FRAME / OUT_RATE} for a, b in spans.tolist()], "tensors": tensors(mel),
        "feature": f"frames={len(mel)};segments={len(spans)};active={covered};spread={spread:.2f};mel=" + ",".join(f"{v:.2f}" for v in mean),
    }


def audio_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and FEATURES of each row of (doc_id, n_bytes, media)."""

    def batches(it):
        for batch in it:
            ids, sizes, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, n_bytes, blob in zip(ids[at : at + 256], sizes[at : at + 256], blobs[at : at + 256], strict=True):
                    rows.append({"doc_id": doc_id, "n_bytes": n_bytes} | (features(blob.as_buffer().to_pybytes()) if blob.is_valid else {}))
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(batches, f"doc_id long, n_bytes long, {FEATURES}")


def as_tensors(log_mel: pa.Array) -> pa.ExtensionArray:
    """The tensors' bytes as one Arrow array of fixed-shape tensors."""
    size = TENSOR_SHAPE[0] * TENSOR_SHAPE[1]
    data = pa.py_buffer(b"".join(log_mel.to_pylist()))
    flat = pa.Array.from_buffers(pa.float16(), len(log_mel) * size, [None, data])
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), TENSOR_SHAPE), pa.FixedSizeListArray.from_arrays(flat, size))


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the digest columns of each document's stored media as read back, and its frames, segments and tensors."""
    stored = Scratch(docs.sparkSession, "media").save(text_media(docs), "media", codec="zstd")
    return audio_features(stored).drop("n_samples")
