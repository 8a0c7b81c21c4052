"""Media columns: features of audio.

Audio is stored as 8-bit mono WAV. Features are computed from the stored bytes: polyphase
resampling to the analysis rate, overlapped log-mel filterbanks, and segmentation of the
energy with hysteresis (a segment opens above a high level and closes below a low one).
Filterbanks become fixed-shape Arrow tensors of (frames, bands) with time spans, in record
batches of an Arrow stream; features are taken from these batches, and a digest of the whole
stream says what was stored. The operator gives the stream itself with ``keep``.

Nulls, ties and odd tables: a null or empty payload is 64 zero bytes, silence without
segments. Filters and tensors go in blocks of frames, so of a long document a task holds its
bytes, one number for each frame, and with ``keep`` its stream. Of equally loud bands the lowest
is named. Equal texts give equal values, repeated rows are computed one by one, and an empty
table gives no rows. Carried columns may have any names; the operator's own results take the
place of carried columns of their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes

HEADER = 44


@dataclass(frozen=True)
class Params:
    rate: int = 16_000  # of the stored samples
    to_rate: int = 8_000  # of the analysis
    taps: int = 16  # of the filter, for each phase, at either side
    frame: int = 200  # samples at to_rate: 25 ms
    hop: int = 80  # 10 ms
    fft: int = 256
    bands: int = 40
    rows: int = 98  # frames in a tensor: about a second
    high: float = 0.6  # levels of the segmentation, as parts of the range between quiet and loud
    low: float = 0.4


def to_wav(payload: bytes, rate: int) -> bytes:
    """8-bit mono WAV; every byte is a sample, so nothing is lost."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVE" + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples, found by walking the chunks."""
    at, rate, data = 12, 0, b""
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return rate, data


@lru_cache(maxsize=8)
def filters(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of 2 * taps weights for each of the ``up`` phases."""
    width = 2 * taps * up
    t = (np.arange(width) - (width - 1) / 2) / up
    cut = min(1.0, up / down)
    h = (cut * np.sinc(cut * t) * np.hanning(width + 2)[1:-1]).reshape(2 * taps, up).T[:, ::-1]
    return np.ascontiguousarray(h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, begin: int, end: int, rate: int, to_rate: int, taps: int) -> np.ndarray:
    """Samples [begin, end) at ``to_rate``; ``x`` is taken as zero outside its ends."""
    g = math.gcd(rate, to_rate)
    up, down = to_rate // g, rate // g
    h = filters(up, down, taps)
    n = np.arange(begin, end, dtype=np.int64) * down
    first = int(n[0] // up) - taps + 1 if len(n) else 0
    last = int(n[-1] // up) + taps + 1 if len(n) else 0
    own = x[max(0, first) : max(0, last)]
    padded = np.zeros(last - first, np.float32)
    padded[max(0, -first) : max(0, -first) + len(own)] = own
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
    out = np.empty(len(n), np.float32)
    for phase in range(up):
        mine = np.flatnonzero(n % up == phase)
        if len(mine):
            at = n[mine] // up - taps + 1 - first
            step = int(at[1] - at[0]) if len(at) > 1 else 1
            out[mine] = views[at[0] : at[-1] + 1 : step] @ h[phase]
    return out


@lru_cache(maxsize=8)
def mel(bands: int, fft: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (fft // 2 + 1, bands)."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    left, mid, right = hz[:-2], hz[1:-1], hz[2:]
    return np.maximum(0, np.minimum((f[:, None] - left) / (mid - left), (right - f[:, None]) / (right - mid))).astype(np.float32)


def log_mel(media: bytes, p: Params) -> Iterator[np.ndarray]:
    """Log-mel frames of a stored WAV, in blocks of whole tensors' worth of frames but for the last."""
    rate, samples = from_wav(media)
    x = np.frombuffer(samples, np.uint8)
    n = len(x) * p.to_rate // rate
    frames = max(1, -(-(n - p.frame) // p.hop) + 1)
    window, bank, step = np.hanning(p.frame).astype(np.float32), mel(p.bands, p.fft, p.to_rate), 64 * p.rows
    for begin in range(0, frames, step):
        end = min(frames, begin + step)
        a, b = begin * p.hop, (end - 1) * p.hop + p.frame
        lo, hi = max(0, (a - 2 * p.taps) * rate // p.to_rate), min(len(x), (b + 2 * p.taps) * rate // p.to_rate + 1)
        lo -= lo % (rate // math.gcd(rate, p.to_rate))
        part = (x[lo:hi].astype(np.float32) - 128) / 128
        shift = lo * p.to_rate // rate
        y = resample(part, a - shift, b - shift, rate, p.to_rate, p.taps)
        view = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop]
        power = np.abs(np.fft.rfft(view * window, p.fft)) ** 2
        yield np.log(power.astype(np.float32) @ bank + 1e-6)


def segments(energy: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Frames [begin, end) that are active, with hysteresis between two levels of the energy's range."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-3:
        return []
    up, down = energy > low + p.high * (high - low), energy < low + p.low * (high - low)
    state = np.where(up, 1, np.where(down, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    active = np.where(known >= 0, state[known] == 1, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], active, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(media: bytes, p: Params) -> Iterator[pa.RecordBatch]:
    """Batches of fixed-shape tensors (rows, bands) with start and end in seconds and the number of frames; the last tensor is padded with its lowest value."""
    kind, at = pa.fixed_shape_tensor(pa.float32(), (p.rows, p.bands)), 0
    for block in log_mel(media, p):
        n = -(-len(block) // p.rows)
        short = n * p.rows - len(block)
        if short:
            block = np.vstack([block, np.full((short, p.bands), block[(n - 1) * p.rows :].min(), np.float32)])
        frames = np.full(n, p.rows)
        frames[-1] -= short
        start = at + np.arange(n) * p.rows
        flat = pa.FixedSizeListArray.from_arrays(pa.array(block.ravel(), pa.float32()), p.rows * p.bands)
        spans = [pa.array(x) for x in (start * p.hop / p.to_rate, ((start + frames - 1) * p.hop + p.frame) / p.to_rate)]
        yield pa.RecordBatch.from_arrays([*spans, pa.array(frames, pa.int32()), pa.ExtensionArray.from_storage(kind, flat)], names=["start_s", "end_s", "n_frames", "log_mel"])
        at += n * p.rows - short


class Digest:
    """A sink for an Arrow stream: its sha256, and the bytes where they are wanted."""

    closed = False

    def __init__(self, keep: bool) -> None:
        self.sha, self.size, self.parts = hashlib.sha256(), 0, [] if keep else None

    def write(self, data) -> int:
        raw = memoryview(data).cast("B")
        self.sha.update(raw)
        self.size += len(raw)
        if self.parts is not None:
            self.parts.append(bytes(raw))
        return len(raw)

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


def features(media: bytes, p: Params, keep: bool = False) -> tuple[str, list[tuple[float, float]], int, Digest]:
    """A digest of the features, the active spans in seconds, how many tensors there are, and their stream.

    The digest names frames, segments, active frames, the mean and the deviation of the
    log-mel energy and the loudest band, rounded so that it doesn't hang on last bits.
    """
    energy, bands, n, square, many, sink = [], 0.0, 0, 0.0, 0, Digest(keep)
    out = None
    for batch in tensors(media, p):
        if out is None:
            out = pa.ipc.new_stream(pa.PythonFile(sink, "w"), batch.schema)
        out.write_batch(batch)
        block = batch.column("log_mel").storage.flatten().to_numpy().reshape(-1, p.bands)
        block = block[: int(batch.column("n_frames").to_numpy().sum())]
        energy.append(block.mean(axis=1, dtype=np.float64))
        bands = bands + block.sum(axis=0, dtype=np.float64)
        square += float((energy[-1] ** 2).sum())
        n, many = n + len(block), many + batch.num_rows
    out.close()
    level = np.concatenate(energy)
    found = segments(np.round(level, 4), p)
    mean = float(np.sum(bands)) / n / p.bands
    spread = math.sqrt(max(0.0, square / n - mean * mean))
    text = f"frames={n};segments={len(found)};active={sum(b - a for a, b in found)};mean={mean:.3f};sd={spread:.3f};band={int(np.argmax(np.round(bands / n, 4)))}"
    return text, [(a * p.hop / p.to_rate, ((b - 1) * p.hop + p.frame) / p.to_rate) for a, b in found], many, sink


def payload(text: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


SCHEMA = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "n_tensors bigint, tensor_bytes bigint, tensor_sha256 string, spans array<struct<start_s:double,end_s:double>>"
)


def audio_columns(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), p: Params = Params(), keep: bool = False) -> DataFrame:
    """Digests, features and active spans of each document's bytes as audio.

    With ``keep`` also ``media``, the stored WAV, and ``tensors``, the Arrow stream of fixed-shape log-mel tensors.
    """
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")] + ["media", "tensors"] * keep
    carry = tuple(c for c in carry if c not in names)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), SCHEMA]) + ", media binary, tensors binary" * keep
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), span, pa.binary(), pa.binary()]

    def one(raw: bytes) -> list:
        media = to_wav(payload(raw), p.rate)
        back = from_wav(media)[1]
        text_, active, many, stream = features(media, p, keep)
        row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), text_]
        row += [many, stream.size, stream.sha.hexdigest(), [{"start_s": a, "end_s": b} for a, b in active]]
        return row + ([media, b"".join(stream.parts)] if keep else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            data, off = text_bytes(part.column(text))
            raw = data.tobytes()
            rows = [one(raw[a:b]) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names)))], names=[*carry, *names])

    return docs.select(*dict.fromkeys((*carry, text))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audio_columns(docs)
