"""Media columns: payloads kept as WAV audio, with spectral-peak fingerprints.

Method: a payload is stored as the 8-bit mono samples of a WAV file by the wave module, the files as a binary column of a
Parquet table in the shared folder; that table is read back, and the wave module reads the files. Short-time
Fourier transforms of the stored samples (window 256, hop 128, Hann) give spectral peaks: in each frame the strongest bins
that exceed their neighbours in frequency. Each peak is paired with peaks of the next frames; a pair's frequencies and
distance in time make a hash, and the fingerprint is the time-coded array of (frame, hash) as 64-bit integers,
frame in the high 32 bits.

Defined cases: null and empty texts are 64 zero bytes; a payload is padded with zero bytes to a positive multiple of
64; equal texts give equal values; a silent payload has an empty fingerprint; repeated rows give equal rows; an empty
table gives an empty result; columns other than id and text are not read. Whole texts are stored and transformed, long ones
in slices that overlap by a window.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from .common import bounded_batches, text_udf

RATE, WINDOW, HOP = 8000, 256, 128
#: Peaks kept in a frame, and the frames after it with which they are paired.
PEAKS, REACH = 3, 2
#: Frames transformed at once.
SLICE = 2048
UNIT = 64
#: Rows of an Arrow batch, which holds their texts, files and arrays at once, and rows worked on at once.
ROWS, AT_ONCE = 128, 32


def to_payload(raw: bytes) -> bytes:
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored)) as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x PEAKS) bins of the strongest local maxima, strongest first, -1 where there are fewer; and how many frames."""
    n = max(1, -(-max(0, len(samples) - WINDOW) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    hann = np.hanning(WINDOW).astype(np.float32)
    bins = np.full((n, PEAKS), -1, np.int64)
    for i in range(0, n, SLICE):
        power = np.abs(np.fft.rfft(frames[i : i + SLICE] * hann, axis=1))[:, 1:]  # without the mean
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1e-3), np.round(inner, 3), -1)
        best = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
        bins[i : i + SLICE] = np.where(np.take_along_axis(top, best, 1) > 0, best + 2, -1)
    return bins, np.arange(n)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Sorted (frame << 32 | hash) of peak pairs; hash = bin, later bin and distance in frames."""
    bins, frames = spectral_peaks(samples)
    made = []
    for gap in range(1, REACH + 1):
        a, b = bins[:-gap], bins[gap:]
        if not len(a):
            continue
        left, right = np.repeat(a, PEAKS, axis=1), np.tile(b, (1, PEAKS))
        code = (frames[: len(a), None] << 32) | (left << 16) | (right << 4) | gap
        made.append(code[(left >= 0) & (right >= 0)])
    return np.sort(np.concatenate(made)) if made else np.zeros(0, np.int64)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every row's payload as the bytes of a WAV file."""
    bounded_batches(df.sparkSession, ROWS)

    def start():
        def work(texts):
            raws = [(t or "").encode() for t in texts]
            return {"n_bytes": pa.array([len(r) for r in raws], pa.int64()), "media": pa.array([to_wav(to_payload(r)) for r in raws], pa.binary())}

        return work

    return df.select(F.col(id_col), text_udf("struct<n_bytes: bigint, media: binary>", start, rows=AT_ONCE)(text_col).alias("_r")).select(id_col, "_r.*")


def described(media: DataFrame) -> DataFrame:
    """Add to a table's ``media``, WAV files, what is read back from them: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_pairs and the time-coded array ``fingerprint``."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_pairs": pa.int64(), "fingerprint": pa.list_(pa.int64())}
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int64()): "array<bigint>"}

    def row(wav: bytes) -> tuple:
        back = from_wav(wav)
        marks = fingerprint(np.frombuffer(back, np.uint8))
        feature = f"{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), feature, len(marks), marks

    def start():
        def work(wavs):
            columns = list(zip(*map(row, wavs), strict=True)) or [()] * len(kinds)
            return {k: pa.array(c, kind) for (k, kind), c in zip(kinds.items(), columns, strict=True)}

        return work

    bounded_batches(media.sparkSession, ROWS)
    schema = ", ".join(f"{k}: {names[kind]}" for k, kind in kinds.items())
    return media.select("*", text_udf(f"struct<{schema}>", start, rows=AT_ONCE)("media").alias("_r")).select(*media.columns, "_r.*")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns of contract op10 for every row, the WAV files (media) and the time-coded arrays (fingerprint). The files are
    written as a table to ``path`` (a scratch folder if None), and all that is said of them is read back from there."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession, "media")
    stored(df, id_col, text_col).write.parquet(path)
    out = described(spark.read.parquet(path))
    return out.select(id_col, "n_bytes", *[c for c in out.columns if c not in (id_col, "n_bytes", "media", "fingerprint")], "media", "fingerprint")
