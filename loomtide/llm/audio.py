"""Media columns: 8-bit audio, its log-mel features and its loud segments.

Samples are stored as a WAV file of unsigned 8-bit samples, read back, resampled
by a polyphase filter, and cut into overlapping frames.  A segment starts where
the frame energy passes an upper threshold and ends where it falls below a lower
one.  Segments become windows of a fixed number of frames, kept as fixed-shape
Arrow tensors with their time spans.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.shared import slices, tidied

RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, FFT, BANDS, WINDOW = 200, 80, 256, 26, 32
OPEN_DB, CLOSE_DB = 0.5, -0.5  # against the mean frame energy
PART = 2048  # frames that are transformed at a time


def pad_payload(data: bytes, unit: int = 64) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@functools.lru_cache
def _lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1]
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Change the rate by ``up / down``: each output sample uses only the filter taps of its phase."""
    if up == down:
        return x
    h = _lowpass(up, down)
    centre = len(h) // 2
    n_out = -(-len(x) * up // down)
    taps = -(-len(h) // up)
    out = np.empty(n_out, np.float32)
    padded = np.concatenate([np.zeros(taps, np.float32), x, np.zeros(taps + centre // up + 1, np.float32)])
    windows = sliding_window_view(padded, taps)
    for r in range(min(up, n_out)):
        n = np.arange(r, n_out, up)
        phase = (r * down + centre) % up
        newest = (n * down + centre) // up  # input sample of the phase's first tap
        bank = np.zeros(taps, np.float32)
        bank[: len(h[phase::up])] = h[phase::up]
        start = newest + taps - (taps - 1)
        step = down if up == 1 else 1
        picked = windows[start[0] : start[-1] + 1 : step] if up == 1 else windows[start]
        out[r::up] = picked @ bank[::-1]
    return out


@functools.lru_cache
def _mel(rate: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


_HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands and log energy of overlapping frames; a short signal is padded to one frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = sliding_window_view(x, FRAME)[::HOP]
    bands, energy = np.empty((len(frames), BANDS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), PART):
        part = frames[at : at + PART]
        spectrum = np.fft.rfft(part * _HANN, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        bands[at : at + PART] = np.log(power @ _mel(rate) + 1e-6)
        energy[at : at + PART] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    return bands, energy


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> list[tuple[int, int]]:
    """(first, end) frames between a rise above the upper and a fall below the lower threshold; all frames if none rises."""
    mean = float(energy.mean())
    up, low = np.flatnonzero(energy > mean + open_db), np.flatnonzero(energy < mean + close_db)
    out, at = [], 0
    while (i := np.searchsorted(up, at)) < len(up):
        first = int(up[i])
        j = np.searchsorted(low, first)
        at = int(low[j]) if j < len(low) else len(energy)
        out.append((first, at))
    return out or [(0, len(energy))]


def tensors(bands: np.ndarray, spans: list[tuple[int, int]], rate: int) -> pa.RecordBatch:
    """Windows of ``WINDOW`` frames of the segments as fixed-shape tensors (zeros fill the last one), with start and end in seconds."""
    cuts = [(a, min(a + WINDOW, z)) for first, z in spans for a in range(first, z, WINDOW)]
    cube = np.zeros((len(cuts), WINDOW, BANDS), np.float32)
    for k, (a, z) in enumerate(cuts):
        cube[k, : z - a] = bands[a:z]
    edges = np.array(cuts, np.float64) * (HOP / rate)
    return pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(cube), pa.array(edges[:, 0]), pa.array(edges[:, 1] + (FRAME - HOP) / rate)], ["log_mel", "start_s", "end_s"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: bytes, up: int = UP, down: int = DOWN) -> tuple[bytes, bytes, str]:
    """(samples, tensors as an Arrow stream, summary) of a stored WAV file."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    low_rate = rate * up // down
    bands, energy = log_mel(resample(x, up, down), low_rate)
    spans = segments(energy)
    batch = tensors(bands, spans, low_rate)
    means = ",".join(f"{v:.2f}" for v in bands.mean(axis=0)[:: BANDS // 5].tolist())
    return samples, to_ipc(batch), f"frames={len(bands)};segments={len(spans)};windows={batch.num_rows};seconds={batch.column(2)[-1].as_py():.3f};bands={means}"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """One row per input row: doc_id, sizes and digests of payload and stored file, feature summary.

    ``with_media`` adds the WAV file and the tensors (an Arrow stream with columns
    log_mel, start_s, end_s) as binary columns.  A null text is empty; an empty
    text is stored as one unit of zero bytes.  Repeats and null doc_ids stay;
    an empty table gives no rows.  Other columns are not read.
    """

    def run(batches):
        for part in slices(batches, 1, 64, 1 << 20):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = text.encode()
                media = to_wav(pad_payload(raw))
                samples, stream, summary = describe(media)
                summary = f"{summary};tensor={hashlib.sha256(stream).hexdigest()[:16]}"
                row = (doc_id, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary)
                rows.append((*row, media, stream) if with_media else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            names = [*(c.split()[0] for c in _COLUMNS.split(", ")), "media", "tensors"]
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds[: len(cols)], strict=True)], names[: len(cols)])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(tidied(run), _COLUMNS + (", media binary, tensors binary" if with_media else ""))
