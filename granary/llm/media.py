"""Audio columns: WAV bytes read by the wave module, and spectral-peak pair fingerprints.

The samples are cut into frames of FRAME, each of which goes through a Hann window and a Fourier transform. A peak is a
bin that is louder than its neighbours in frequency and in time; the PEAKS loudest of each frame count. Each peak is
paired with the PAIRS next ones of the following REACH frames, and a pair's code holds both frequencies and the distance:
two recordings of one sound share codes at a constant shift of time.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import need, row_slices, text_slices

FRAME, HOP, PEAKS, PAIRS, REACH = 256, 128, 3, 3, 31
#: Frames that are transformed at a time.
BLOCK = 2048
#: A peak has at least this power: no rounding noise of silence.
FLOOR = 1e-6


def read_wav(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(frames a second, channels, samples from -1 to 1, mean of the channels) of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, channels, width, data = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    data = data[: len(data) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel().astype(np.float32) / 2**31
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return rate, channels, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def write_wav(samples: bytes, rate: int = 8000) -> bytes:
    """A WAV file of one channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def spectrogram(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Power of frames ``first`` to ``last`` (without it) of the samples, by bin."""
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[first * HOP : (last - 1) * HOP + 1 : HOP]
    f = np.fft.rfft((view * _HANN).astype(np.float32), axis=1)
    return (f.real**2 + f.imag**2).astype(np.float32)


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks of the samples, by frame and then bin. Samples short of a frame are filled up with 0."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = -max(len(x) - FRAME, 0) % HOP if len(x) >= FRAME else FRAME - len(x)
    x = np.pad(x, (0, short)) if short else x
    n = (len(x) - FRAME) // HOP + 1
    frames, bins = [], []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = max(lo - 1, 0), min(hi + 1, n)
        s = spectrogram(x, a, b)
        edge = np.zeros((1, s.shape[1]), s.dtype)
        s = np.concatenate([*([edge] if a == lo else []), s, *([edge] if b == hi else [])])
        mid = s[1:-1, 1:-1]
        top = (mid > s[1:-1, :-2]) & (mid > s[1:-1, 2:]) & (mid > s[:-2, 1:-1]) & (mid >= s[2:, 1:-1]) & (mid > FLOOR)
        loud = np.where(top, mid, 0)
        # The PEAKS loudest of each frame; of equally loud ones the lower bin.
        for_frame = np.argsort(-loud, axis=1, kind="stable")[:, :PEAKS] if loud.shape[1] > PEAKS else np.tile(np.arange(loud.shape[1]), (len(loud), 1))
        real = np.take_along_axis(loud, for_frame, axis=1) > 0
        t = np.broadcast_to(np.arange(lo, hi)[:, None], for_frame.shape)[real]
        f = for_frame[real] + 1
        order = np.lexsort((f, t))
        frames.append(t[order])
        bins.append(f[order])
    return np.concatenate(frames), np.concatenate(bins)


def fingerprints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time in frames, code) of the peak pairs of the samples, by time; code = (first bin << 13) + (second bin << 5) + distance."""
    t, f = peaks(x)
    times, codes = [], []
    after = np.searchsorted(t, t, side="right")
    for k in range(PAIRS):
        other = after + k
        ok = other < len(t)
        i, j = np.flatnonzero(ok), other[ok]
        near = t[j] - t[i] <= REACH
        i, j = i[near], j[near]
        times.append(t[i])
        codes.append((f[i] << 13) + (f[j] << 5) + (t[j] - t[i]))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def fingerprint_audio(df: DataFrame, key: str, wav: str) -> DataFrame:
    """(key, rate, channels, samples, times, codes) of every row of ``df``; times and codes are arrays of equal length, by time.

    A null or unreadable file gives nulls, one without samples empty arrays; a header may name any rate. Whole recordings are read. Null keys and
    repeated rows are handled as any others; other columns are not returned. An empty table gives no rows.
    """
    need(df, key, wav)
    names = [key, "rate", "channels", "samples", "times", "codes"]
    kind = df.schema[key].dataType.simpleString()
    if key in names[1:]:
        raise ValueError(f"the key must not be called {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in row_slices(sizes, 4 << 20):
                rows: list[list] = [[] for _ in range(5)]
                for raw in whole.column(1).slice(lo, hi - lo).to_pylist():
                    try:
                        rate, channels, x = read_wav(raw)
                    except (wave.Error, struct.error, EOFError, OverflowError, RuntimeError, TypeError, ValueError):
                        values = (None,) * 5
                    else:
                        values = (rate, channels, len(x), *fingerprints(x))
                    for column, v in zip(rows, values):
                        column.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(rows, types))], names)

    return df.select(key, wav).mapInArrow(run, f"`{key}` {kind}, rate bigint, channels int, samples bigint, times array<int>, codes array<int>")


def sonify(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, wav): the UTF-8 bytes of each whole text as 8-bit samples of a WAV file; null for null.

    The tables have no audio; this makes a media column of known content out of one that they have. An empty text gives
    a file without samples. Null keys, repeated rows and ties are handled as any others; other columns are not returned. An
    empty table gives no rows.
    """
    need(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in text_slices(b.column(1)):
                files = [None if x is None else write_wav(x) for x in part.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), pa.array(files, pa.binary())], [key, "wav"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, wav binary")
