"""Media columns: WAV files as binary values, and spectral fingerprints of what they hold.

A payload becomes 8-bit mono samples, byte for byte, in a WAV container written and read by the ``wave`` module. Features
come from a short-time Fourier transform of the samples read back: the strongest local maxima of each frame are paired with
each other and with those of the next frames, and each pair is one integer that holds the frame's number, both bins and the
distance. Payloads of under four frames' length have shorter frames, the longest power of two that is a quarter at most.

Defined results: a null or empty text is one block of 64 zero bytes; a null media value has null payload and fingerprint; a
silent frame has no peaks, so a payload of one level that is silence (all 0 or all 128) has an empty fingerprint, and no other
payload has; an empty table gives an empty result. Equal texts give equal values; texts of a few words may share theirs with
others, as only the places of peaks count. Transforms run over blocks of frames, so memory follows the text and not its transform.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

RATE, BLOCK = 8000, 64
FRAME, HOP, PEAKS, FAN = 512, 256, 2, 2
#: Frames of short payloads are no shorter than this.
LEAST_FRAME = 16
FRAMES_AT_ONCE = 2048


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def frame_size(n: int) -> int:
    """Samples in a frame of a payload of n: FRAME, or less so that a short payload has several frames."""
    return min(FRAME, max(LEAST_FRAME, 1 << max(0, (n // 4).bit_length() - 1)))


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """Bins of the PEAKS strongest local maxima of each frame, strongest first; -1 where there are fewer.

    A payload without any local maximum that isn't silence has each frame's strongest bin.
    """
    size = frame_size(len(samples))
    hop = HOP * size // FRAME
    n = max(1, -(-max(0, len(samples) - size) // hop) + 1)
    level = np.zeros((n - 1) * hop + size, dtype=np.float32)
    level[: len(samples)] = samples
    if samples.any():
        level[: len(samples)] -= np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(level, size)[::hop]
    window = np.hanning(size + 1)[:-1].astype(np.float32)
    out = np.full((n, PEAKS), -1, dtype=np.int64)
    strongest = np.full(n, -1, dtype=np.int64)
    for a in range(0, n, FRAMES_AT_ONCE):
        z = np.fft.rfft(frames[a : a + FRAMES_AT_ONCE] * window, axis=1)
        power = z.real**2 + z.imag**2
        strongest[a : a + len(power)] = np.where(power.any(axis=1), power.argmax(axis=1), -1)
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        rows = np.arange(len(top))
        for k in range(PEAKS):
            at = top.argmax(axis=1)
            out[a : a + len(top), k] = np.where(top[rows, at] > 0, at + 1, -1)
            top[rows, at] = 0
    if (out < 0).all() and level.any():
        out[:, 0] = strongest
        out[0, 0] = max(out[0, 0], 0)  # the window leaves nothing of a first sample that stands alone
    return out


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded pairs, int64: frame << 32 | first bin << 20 | second bin << 8 | frames between; by frame, then pair.

    In one frame, 0 frames between, the strongest is paired with each other peak, or with itself if it is the only one.
    """
    peaks = spectral_peaks(np.frombuffer(payload, dtype=np.uint8))
    n = len(peaks)
    t = np.arange(n, dtype=np.int64)
    first, second = peaks[:, :1], np.where(peaks[:, 1:2] < 0, peaks[:, :1], peaks[:, 1:])
    found = [np.where((first >= 0) & (second >= 0), (t[:, None] << 32) | (first << 20) | (second << 8), -1).ravel()]
    for ahead in range(1, FAN + 1):
        first, second = peaks[: n - ahead, :, None], peaks[ahead:, None, :]
        code = (t[: n - ahead, None, None] << 32) | (first << 20) | (second << 8) | ahead
        found.append(np.where((first >= 0) & (second >= 0), code, -1).ravel())
    codes = np.concatenate(found)
    return np.sort(codes[codes >= 0])


def _mapped(df: DataFrame, schema: T.StructType, change) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch)

    return map_batches(df, run, schema)


def wav_column(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs without the text, with its UTF-8 bytes, padded, as a WAV file in media_col (a column of that name is replaced)."""
    keep = [f for f in docs.schema if f.name not in (text_col, media_col)]
    names = [f.name for f in keep]

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(names)).cast(pa.binary()).to_pylist()
        stored = pa.array([to_wav(padded(x or b"")) for x in texts], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], stored], [*names, media_col])

    return _mapped(docs.select(*names, docs[text_col].cast("string")), T.StructType([*keep, T.StructField(media_col, T.BinaryType())]), change)


def wav_features(df: DataFrame, media_col: str = "media", payload_col: str = "payload", fingerprint_col: str = "fingerprint") -> DataFrame:
    """df with the payload read back from each WAV file and its fingerprint (columns of these names are replaced)."""
    keep = [f for f in df.schema if f.name not in (payload_col, fingerprint_col)]
    names = [f.name for f in keep]

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [None if x is None else from_wav(x) for x in batch.column(names.index(media_col)).to_pylist()]
        codes = pa.array([None if x is None else fingerprint(x) for x in read], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(read, pa.binary()), codes], [*names, payload_col, fingerprint_col])

    new = [T.StructField(payload_col, T.BinaryType()), T.StructField(fingerprint_col, T.ArrayType(T.LongType()))]
    return _mapped(df.select(*names), T.StructType([*keep, *new]), change)
