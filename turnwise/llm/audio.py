"""Audio features of a media column.

Bytes are stored as 8-bit mono samples in a RIFF/WAVE container, written as a Parquet column and read
back. Features come from the samples read back: they are resampled by a polyphase filter, framed with
overlap into log-mel energies, and cut into segments where the frame energy passes a high threshold
and stays above a low one. The energies are patches of one fixed shape with their spans of time.
"""
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.lineage import new_folder
from turnwise.llm.common import whole

RATE = 16_000  # samples a second as stored
UP, DOWN = 1, 2  # resampling, so features are of 8,000 samples a second
TAPS = 16  # filter taps per phase
FRAME, HOP = 256, 128  # samples
MELS = 16
PATCH = 64  # frames of a tensor
HIGH, LOW = 1.5, 0.5  # standard deviations over the mean energy that start and end a segment
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """The bytes as unsigned 8-bit mono samples."""
    size = len(payload)
    return HEADER.pack(b"RIFF", 36 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size) + payload + b"\0" * (size % 2)


def from_wave(wave: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a container with 8-bit mono samples; other chunks are skipped."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE container")
    at, rate = 12, 0
    while at + 8 <= len(wave):
        name, size = struct.unpack_from("<4sI", wave, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wave, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            return rate, np.frombuffer(wave, dtype=np.uint8, count=size, offset=at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, one row of taps per output phase."""
    half = taps * max(up, down) // 2
    n = np.arange(-half, half)
    cut = 1 / max(up, down)
    low = cut * np.sinc(n * cut) * np.hanning(2 * half + 2)[1:-1]
    low *= up / low.sum()
    rows = -(-len(low) // up)
    return np.pad(low, (0, rows * up - len(low))).reshape(rows, up).T.copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at up / down of its rate; ends are padded with zeros.

    Output sample m lies at phase m * down mod up of input sample m * down // up. The samples of a phase
    are a fixed stride apart, so a phase is one sum of strided slices, one per tap.
    """
    rows = _phases(up, down).astype(x.dtype)
    width = rows.shape[1]
    out = np.empty(-(-len(x) * up // down), dtype=x.dtype)
    padded = np.concatenate([np.zeros(width, x.dtype), x, np.zeros(width + down, x.dtype)])
    for first in range(min(up, len(out))):
        count = len(range(first, len(out), up))
        centre, phase = divmod(first * down, up)
        total = np.zeros(count, x.dtype)
        for k in range(width):
            start = centre + width + width // 2 - k
            total += rows[phase, k] * padded[start:start + (count - 1) * down + 1:down]
        out[first::up] = total
    return out


@lru_cache(maxsize=4)
def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles with equal steps on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    up = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel energies by frame, energy of each frame) of overlapped Hann frames.

    The signal is padded with silence to a whole number of hops and one more, so its end lies in the middle of the last frame.
    """
    x = np.pad(x, (0, max(FRAME - len(x), -len(x) % HOP + HOP)))
    frames = 1 + (len(x) - FRAME) // HOP
    window, filters = np.hanning(FRAME + 1)[:-1].astype(np.float32), mel_filters(rate).astype(np.float32)
    mels, energy = np.empty((frames, MELS), dtype=np.float32), np.empty(frames)
    step = 4096
    view = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), FRAME)[::HOP]
    for at in range(0, frames, step):
        part = view[at:at + step] * window
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        mels[at:at + step] = np.log(power.astype(np.float32) @ filters + 1e-3)
        energy[at:at + step] = np.log((part.astype(np.float64) ** 2).sum(axis=1) + 1e-3)
    return mels, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """[first, last) frames of segments: a frame over the high threshold opens one, and it lasts, both ways, while frames stay over the low one."""
    mean, spread = energy.mean(), energy.std()
    if not spread > 1e-9:
        return []
    over = np.r_[False, energy > mean + low * spread, False]
    edges = np.flatnonzero(over[1:] != over[:-1])
    strong = np.r_[0, np.cumsum(energy > mean + high * spread)]
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if strong[b] > strong[a]]


def features(wave: bytes) -> tuple[list[tuple[float, float, np.ndarray]], list[tuple[float, float]]]:
    """Patches (start, end in seconds, PATCH x MELS tensor in hundredths) and segments (start, end) of one recording."""
    rate, samples = from_wave(wave)
    x = resample((samples.astype(np.float32) - 128) / 128)
    rate = rate * UP // DOWN
    mels, energy = log_mel(x, rate)
    cents = np.round(mels * 100).astype(np.int16)
    second = lambda frame: frame * HOP / rate
    patches = []
    for at in range(0, len(cents), PATCH):
        part = cents[at:at + PATCH]
        filled = np.full((PATCH, MELS), -691, dtype=np.int16)  # silence: ln 0.001
        filled[:len(part)] = part
        patches.append((second(at), second(at + len(part)), filled))
    return patches, [(second(a), second(b)) for a, b in segments(energy)]


def tensor_type() -> pa.DataType:
    """The Arrow type of a patch column: every value has the same shape."""
    return pa.fixed_shape_tensor(pa.int16(), (PATCH, MELS))


def patch_tensors(patches: list[tuple[float, float, np.ndarray]]) -> pa.RecordBatch:
    """Patches as an Arrow batch with a fixed-shape tensor column and time spans."""
    flat = np.concatenate([p.ravel() for *_, p in patches]) if patches else np.zeros(0, np.int16)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(flat), PATCH * MELS)
    return pa.RecordBatch.from_arrays([
        pa.array([a for a, *_ in patches], pa.float64()), pa.array([b for _, b, _ in patches], pa.float64()),
        pa.ExtensionArray.from_storage(tensor_type(), storage)], ["start", "end", "patch"])


def with_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``documents``, written as Parquet and read back from there.

    The payload is the UTF-8 text (a null one is empty), padded with zero bytes to a positive multiple of 64.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = part.column(1).cast(pa.binary()).to_pylist()
            waves = [to_wave(b + b"\0" * (-len(b) % 64 or (64 if not b else 0))) for b in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(waves, pa.binary())], ["doc_id", "n_bytes", "media"])

    path = new_folder(documents.sparkSession, "media")
    made = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text")).mapInArrow(batches, "doc_id bigint, n_bytes bigint, media binary")
    made.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.parquet(path)


def tensor_digest(made: pa.RecordBatch) -> str:
    """SHA-256 over the spans and tensors of a batch of patch_tensors."""
    tensors = made.column(2).to_numpy_ndarray().astype("<i2")
    return hashlib.sha256(b"".join(struct.pack("<dd", a, b) + t.tobytes() for a, b, t in zip(
        made.column(0).to_pylist(), made.column(1).to_pylist(), tensors, strict=True))).hexdigest()


def media_features(media: DataFrame) -> DataFrame:
    """Adds start, end and patch (flat, PATCH x MELS) of every patch of (doc_id, media), in order."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc_id, wave in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                made = patch_tensors(features(wave)[0])
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id] * len(made), pa.int64()), made.column(0), made.column(1),
                    made.column(2).storage.cast(pa.list_(pa.int16()))], ["doc_id", "start", "end", "patch"])

    return media.select(F.col("doc_id").cast("bigint").alias("doc_id"), "media").mapInArrow(batches, "doc_id bigint, start double, end double, patch array<smallint>")


def media_digests(documents: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of payload and stored form as read back, and its features.

    ``feature`` names the number of patches, a digest of the tensors with their spans, and the segments. Equal texts have
    equal values; repeated rows give a row each; an empty table gives none.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for part in parts:
            rows = []
            for wave in part.column(2).to_pylist():
                payload = from_wave(wave)[1].tobytes()
                patches, spans = features(wave)
                digest = tensor_digest(patch_tensors(patches))
                spoken = sum(b - a for a, b in spans)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave),
                             hashlib.sha256(wave).hexdigest(), f"{len(patches)}x{PATCH}x{MELS}:{len(spans)}:{spoken:.3f}:{digest}"))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return with_media(documents).select("doc_id", "n_bytes", "media").mapInArrow(
        batches, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
