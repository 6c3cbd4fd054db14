"""Audio features: polyphase resampling, log-mel filterbanks, hysteresis segments, fixed-shape tensors.

Media are 8-bit mono WAV files. Samples are resampled from 8 kHz to 6 kHz by a polyphase filter, cut into
overlapping windows of 256 samples, and turned into log energies of 16 mel bands. A segment starts where a
window's energy rises over the upper threshold and ends where it falls below the lower one. Band energies are
stored as fixed-shape Arrow tensors of 64 windows by 16 bands, each with its time span; the last is padded
with the floor value. Media are written to the shared folder and read back for the energies, and these are written
and read back for the summaries. Long media are resampled in blocks of BLOCK windows.

Defined results: a null text is the empty one, whose payload is 64 zero bytes; the last window is padded with silence where the media end inside it. Equal payloads give equal values. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, write_shared

RATE, UP, DOWN, TAPS = 8000, 3, 4, 16
WINDOW, HOP, BANDS, FRAMES = 256, 128, 16, 64
OUT_RATE = RATE * UP // DOWN
#: Windows handled at once.
BLOCK = 8192
FLOOR = -12.0


def to_payload(text: str | None) -> tuple[int, bytes]:
    """Length of a text's UTF-8 bytes, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 if raw else 64)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono WAV file of the payload's bytes as samples."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAV file without data")


def _filters() -> np.ndarray:
    """The low-pass filter's phases as one matrix: a window of input by the UP outputs that it makes."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n)
    h *= UP / h.sum()
    out = np.zeros((TAPS + DOWN, UP), np.float32)
    for r in range(UP):
        first, phase = divmod(DOWN * r, UP)
        out[first : first + TAPS, r] = h[phase::UP][::-1]
    return out


def _mel() -> np.ndarray:
    """Triangular bands, evenly spaced in mel, over the bins of a real FFT."""
    top = 2595 * np.log10(1 + OUT_RATE / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / OUT_RATE)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _BANDS, _TAPER = _filters(), _mel(), np.hanning(WINDOW).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Float samples at UP / DOWN times the rate; samples needs TAPS values of context at its end."""
    groups = (len(samples) - TAPS) // DOWN
    view = np.lib.stride_tricks.as_strided(samples, (groups, TAPS + DOWN), (DOWN * samples.strides[0], samples.strides[0]))
    return (np.ascontiguousarray(view) @ _PHASES).reshape(-1)


def log_mel(payload: bytes) -> np.ndarray:
    """Log energies, windows by bands."""
    raw = np.frombuffer(payload, np.uint8)
    n_out = len(raw) * UP // DOWN
    windows = max(1, 1 - (WINDOW - n_out) // HOP)
    out = np.empty((windows, BANDS), np.float32)
    for first in range(0, windows, BLOCK):
        many = min(BLOCK, windows - first)
        lo = first * HOP * DOWN // UP // DOWN * DOWN  # a place in the input at which a group of outputs starts
        skip = first * HOP - lo // DOWN * UP
        need = skip + (many - 1) * HOP + WINDOW
        want = -(-need // UP) * DOWN + TAPS + DOWN
        part = np.zeros(want, np.float32)
        have = raw[lo : lo + want]
        part[: len(have)] = (have.astype(np.float32) - 128) / 128
        y = resample(part)[skip:]
        view = np.lib.stride_tricks.as_strided(y, (many, WINDOW), (HOP * y.strides[0], y.strides[0]))
        power = np.abs(np.fft.rfft(view * _TAPER, axis=1)).astype(np.float32) ** 2
        out[first : first + many] = np.maximum(np.log(power @ _BANDS + np.float32(1e-6)), FLOOR)
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """First and last window of each segment: on above mean + deviation / 2, off below the mean."""
    mean, spread = float(energy.mean()), float(energy.std())
    event = np.where(energy > mean + spread / 2, 1, np.where(energy < mean, -1, 0))
    at = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(at >= 0, event[np.maximum(at, 0)] == 1, False)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)


def tensors(mel: np.ndarray) -> pa.FixedShapeTensorArray:
    """The energies as Arrow tensors of FRAMES by BANDS values."""
    n = -(-len(mel) // FRAMES)
    full = np.full((n * FRAMES, BANDS), FLOOR, np.float32)
    full[: len(mel)] = mel
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, FRAMES, BANDS))


def span_ms(first: int, last: int) -> tuple[int, int]:
    return first * HOP * 1000 // OUT_RATE, (last * HOP + WINDOW) * 1000 // OUT_RATE


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column("text")):
            each = [to_payload(t) for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array([n for n, _ in each], pa.int64()), pa.array([to_wav(p) for _, p in each], pa.binary())], ["doc_id", "n_bytes", "media"]
            )


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes as a WAV file."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, wav in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            mel = log_mel(from_wav(wav))
            held = tensors(mel)
            n = len(held)
            spans = [span_ms(k * FRAMES, min((k + 1) * FRAMES, len(mel)) - 1) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), held.storage.cast(pa.list_(pa.float32()))],
                ["doc_id", "patch", "start_ms", "end_ms", "tensor"],
            )


def features(stored: DataFrame) -> DataFrame:
    """doc_id, patch, start_ms, end_ms, tensor: the FRAMES by BANDS log energies of each stretch of stored media."""
    return stored.select("doc_id", "media").mapInArrow(patches, "doc_id bigint, patch int, start_ms bigint, end_ms bigint, tensor array<float>")


def as_tensors(table: pa.Table) -> pa.Table:
    """A table of features() with its tensor column as Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))
    flat = table.column("tensor").combine_chunks().flatten()
    held = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, FRAMES * BANDS))
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", held)


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, wav in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            spans = [span_ms(*x) for x in segments(log_mel(from_wav(wav)).mean(axis=1)).tolist()]
            n = len(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())], ["doc_id", "segment", "start_ms", "end_ms"]
            )


def segment_spans(stored: DataFrame) -> DataFrame:
    """doc_id, segment, start_ms, end_ms: every hysteresis segment of stored media."""
    return stored.select("doc_id", "media").mapInArrow(segment_rows, "doc_id bigint, segment int, start_ms bigint, end_ms bigint")


SIZES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"
MEASURED, DIGEST = f"{SIZES}, windows bigint, tensors array<float>", f"{SIZES}, feature string"


def describe(windows: int, flat: np.ndarray) -> str:
    """Windows, tensors and their checksum, the time spans of all segments, mean energy of each band; flat: the tensors' values."""
    mel = flat.reshape(-1, BANDS)[:windows]
    found = segments(mel.mean(axis=1))
    spans = ";".join("{}-{}".format(*span_ms(*x)) for x in found.tolist())
    bands = ",".join(f"{x:.2f}" for x in mel.mean(axis=0, dtype=np.float64))
    crc = zlib.crc32(np.round(flat, 2).astype("<f4").tobytes())
    return f"windows={windows} tensors={len(flat) // (FRAMES * BANDS)} crc={crc:08x} segments={len(found)} ms={spans} mel={bands}"


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, digests and tensors of stored media."""
    names = [x.split()[0] for x in MEASURED.split(", ")]
    for batch in batches:
        for lo, hi in slices(batch.column("media")):
            part = batch.slice(lo, hi - lo)
            rows, held = [], []
            for wav in part.column("media").to_pylist():
                payload = from_wav(wav)
                mel = log_mel(payload)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), len(mel)))
                held.append(tensors(mel).storage.flatten().to_numpy())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        found = [describe(n, x.values.to_numpy()) for n, x in zip(batch.column("windows").to_pylist(), batch.column("tensors"), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.string())], names)


def summaries(media: DataFrame) -> DataFrame:
    """Sizes, digests and a description of the features of media; media and tensors are stored and read back."""
    stored = write_shared(media, "media", "zstd")
    return write_shared(stored.mapInArrow(measure, MEASURED), "tensors", "zstd").mapInArrow(digest, DIGEST)
