"""Media columns: audio stored as 8-bit WAV, and features computed from the stored bytes.

``audio_columns`` adds to each row its clip as a media column and what is computed from it: a log-mel
spectrogram over overlapping frames of the resampled signal, cut into windows of a fixed number of
frames, and the loud segments found by an energy detector with two thresholds. Tasks build the
windows as an Arrow fixed-shape tensor array; Spark has no such type, so the column holds the
tensors' storage (one list of TENSOR_FRAMES x MELS values each, row by row) with their time spans.

A null text is an empty clip: 64 zero bytes. Clips of any length are one row; rows alike give results
alike, and null or repeated keys are passed on. Columns of the operator's names are replaced, other
columns go through. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import documents, prepared

#: 3 / 8 of the rate, so that the resampling filter has three phases.
RATE_IN, RATE_OUT = 16_000, 6_000
FRAME, HOP, MELS = 256, 128, 16
#: Frames in one tensor, and frames from one tensor's start to the next.
TENSOR_FRAMES, TENSOR_STEP = 32, 32
TAPS = 8
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload."""
    pad = b"\0" * (len(payload) % 2)
    return HEADER.pack(b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate read back from the file's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _filter(up: int, down: int) -> np.ndarray:
    half = TAPS * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * (0.54 + 0.46 * np.cos(np.pi * t / half))
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Polyphase resampling: output n is the dot product of one phase of the filter with nearby samples."""
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    if up == down:
        return x.astype(np.float32)
    h = _filter(up, down)
    half = len(h) // 2
    n_out = -(-len(x) * up // down)
    reach = half // up + 1
    padded = np.concatenate([np.zeros(reach, np.float32), x.astype(np.float32), np.zeros(reach + 1 + down, np.float32)])
    y = np.zeros(n_out, np.float32)
    for phase in range(up):
        n = np.arange((phase * pow(down, -1, up)) % up if up > 1 else 0, n_out, up)
        if not len(n):
            continue
        first = n[0] * down
        center, offset = divmod(first, up)
        for k in range(-reach, reach + 1):
            tap = half + offset - k * up
            if 0 <= tap < len(h) and h[tap]:
                start = center + k + reach
                y[n] += h[tap] * padded[start : start + down * (len(n) - 1) + 1 : down]
    return y


def mel_filters(rate: int = RATE_OUT, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None).astype(np.float32)


_mel, _window = mel_filters(), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS; silence fills up the last frame, so that every sample is in one."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros(FRAME + (n - 1) * HOP - len(y), np.float32)])
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    for i in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft(frames[i : i + 2048] * _window, axis=1)) ** 2
        out.append(np.log(power @ _mel.T + 1e-6).astype(np.float32))
    return np.concatenate(out)


def segments(level: np.ndarray, start_at: float, stop_at: float) -> list[tuple[int, int]]:
    """Runs of frames that begin where the level reaches ``start_at`` and last until it falls under ``stop_at``."""
    on, off = level >= start_at, level < stop_at
    event = np.where(on, 1, np.where(off, -1, 0))
    at = np.flatnonzero(event)
    if not len(at):
        return []
    kinds = event[at]
    turn = np.flatnonzero(np.diff(np.concatenate([[-1], kinds])))
    edges = at[turn].tolist()
    if len(edges) % 2:
        edges.append(len(level))
    return list(zip(edges[0::2], edges[1::2], strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames of the resampled clip, and its loud segments in frames."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate, RATE_OUT))
    level = mel.mean(axis=1)
    low, high = float(np.percentile(level, 40)), float(np.percentile(level, 70))
    return mel, segments(level, high, low)


def frames_end(after: int, duration: float) -> float:
    """End in seconds of the frames before ``after``; silence after the clip doesn't count."""
    return min(((after - 1) * HOP + FRAME) / RATE_OUT, duration)


def tensors(mel: np.ndarray, duration: float) -> tuple[list[float], list[float], np.ndarray]:
    """Starts and ends in seconds of windows of TENSOR_FRAMES frames, and the windows; the last is padded with silence."""
    first = range(0, len(mel), TENSOR_STEP)
    starts = [i * HOP / RATE_OUT for i in first]
    ends = [frames_end(min(i + TENSOR_FRAMES, len(mel)), duration) for i in first]
    windows = np.full((len(first), TENSOR_FRAMES, MELS), np.log(1e-6), np.float32)
    for n, i in enumerate(first):
        part = mel[i : i + TENSOR_FRAMES]
        windows[n, : len(part)] = part
    return starts, ends, windows


def as_fixed_shape(values: pa.Array) -> pa.FixedShapeTensorArray:
    """Storage of tensors (flattened, one after the other) as an Arrow fixed-shape tensor array."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS), dim_names=("frame", "mel"))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, TENSOR_FRAMES * MELS))


def text_payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of 64, and their number before; null is empty."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\0" * ((-len(raw)) % 64 or 64 * (not raw)), len(raw)


class Clip(NamedTuple):
    n_bytes: int
    media: bytes
    duration_s: float
    n_frames: int
    feature: str
    loud_spans: list[dict[str, float]]
    tensors: tuple[list[float], list[float], np.ndarray]


def clip(text: str | None) -> Clip:
    """A text's clip; everything but the media comes from the media's bytes."""
    payload, n_bytes = text_payload(text)
    media = to_wav(payload)
    samples, rate = from_wav(media)
    duration = len(samples) / rate
    mel, loud = features(samples, rate)
    steps = np.concatenate([mel.mean(axis=0), mel.std(axis=0)])
    feature = np.clip(np.round(steps * 16), -(2**15), 2**15 - 1).astype("<i2").tobytes().hex()
    spans = [{"start_s": a * HOP / RATE_OUT, "end_s": frames_end(b, duration)} for a, b in loud]
    return Clip(n_bytes, media, duration, len(mel), feature, spans, tensors(mel, duration))


SPAN = "start_s: double, end_s: double"
AUDIO_SCHEMA = (
    f"n_bytes long, media binary, duration_s double, n_frames int, feature string, loud_spans array<struct<{SPAN}>>, tensors array<struct<{SPAN}, mel: array<float>>>"
)


def _ends(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())


def _audio(clips: list[Clip]) -> list[pa.Array]:
    """The columns of AUDIO_SCHEMA."""
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    n_bytes, media, duration, n_frames, feature, loud, windows = zip(*clips, strict=True)
    values = np.concatenate([w for _, _, w in windows])
    mel = as_fixed_shape(pa.array(values.ravel())).storage.cast(pa.list_(pa.float32()))
    starts, ends = (pa.array([t for w in windows for t in w[k]], pa.float64()) for k in (0, 1))
    cut = pa.ListArray.from_arrays(_ends([w[0] for w in windows]), pa.StructArray.from_arrays([starts, ends, mel], ["start_s", "end_s", "mel"]))
    types = [pa.int64(), pa.binary(), pa.float64(), pa.int32(), pa.string(), span]
    return [*(pa.array(c, t) for c, t in zip((n_bytes, media, duration, n_frames, feature, loud), types, strict=True)), cut]


def audio_columns(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the columns of AUDIO_SCHEMA for the column ``text``."""
    added = T.StructType.fromDDL(AUDIO_SCHEMA)
    kept = [c for c in df.columns if c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                clips = [clip(t) for t in batch.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_audio(clips)], [*kept, *added.names])

    prepared(df.sparkSession)
    rows = df.select(*kept, df[text].alias("__text"))
    return rows.mapInArrow(run, T.StructType([*df.select(*kept).schema.fields, *added.fields]))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a stored clip: sums of the stored form, a digest of its features, and the tensors themselves.

    ``tensors`` holds each tensor's time span and values, ``tensor_shape`` their shape.
    """
    found = audio_columns(documents(spark, sf_dir).select("doc_id", "text"), "text").drop("text")
    payload = F.expr(f"substring(media, {HEADER.size + 1}, n_bytes + if(n_bytes = 0, 64, pmod(-n_bytes, 64)))")
    found = found.withColumn("payload", payload)
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature", "duration_s", "n_frames", "loud_spans",
        F.array(F.lit(TENSOR_FRAMES), F.lit(MELS)).alias("tensor_shape"),
        "tensors",
    )
