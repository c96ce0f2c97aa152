"""Media columns: audio storage and features (operator 8).

Storage is native: a text's UTF-8 bytes, padded with zero bytes up to a positive multiple of 64, become
the 8-bit samples of a mono WAV file in a binary column; nothing is lost. Feature extraction reads the
stored bytes back, resamples them by a polyphase filter, takes overlapped log-mel filterbanks,
and segments the energy with hysteresis (a segment opens above the upper threshold and lasts until the lower one).

Features come as blocks of one fixed shape (``BLOCK`` frames x ``MELS`` of half-precision floats, a binary in Spark, which has no such type; the last block is zero-padded), each with its time span;
``as_tensors`` gives a column of them the Arrow type ``fixed_shape_tensor`` without a copy. All that is computed of a recording depends on its
own samples only, piece by piece of fixed length, so equal texts give equal values and memory is bounded by the text.

Defined results: a null or empty text gives 64 zero samples; silence has no segment; other columns pass through,
but ``n_bytes media`` and the feature columns replace those of the input.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import SLICE, flat_map, ship, to_arrow_schema

UNIT = 64
#: 16 kHz to 10 kHz; frames of 25 ms, 10 ms apart.
RATE, UP, DOWN = 16_000, 5, 8
FRAME, HOP, FFT, MELS = 250, 100, 256, 32
BLOCK = 64
#: Tensors hold half-precision floats (a log-mel energy is exact to 0.004).
HALF = np.float16
#: Frames that are transformed at once.
PIECE = 4096
TAPS = 16
#: Thresholds of the segmentation, in standard deviations above the mean of a recording's frame energies.
OPEN, CLOSE = 0.5, -0.25


def wav(text: Column, rate: int = RATE) -> Column:
    """The WAV file (binary) of a text: 44 bytes of header, then the padded payload."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(body)
    size = F.greatest(F.lit(UNIT), F.ceil(n / F.lit(UNIT)).cast("int") * UNIT)
    little = lambda x: F.unhex(F.regexp_replace(F.lpad(F.hex(x), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    fixed = lambda data: F.lit(data).cast("binary")
    return F.concat(
        fixed(b"RIFF"), little(size + 36), fixed(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"), little(size),
        body, F.unhex(F.repeat(F.lit("00"), size - n)),
    )


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (of the text) and ``media`` (its WAV file)."""
    return docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "media": wav(F.col(text))})


def samples(media: bytes) -> tuple[int, bytes]:
    """Rate and payload of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def low_pass(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """A windowed-sinc filter of ``taps`` coefficients a phase, cut off at the lower of the two Nyquist rates."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output k uses only the filter's phase k*down % up; zeros are never multiplied."""
    h = low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        ks = np.arange(first, n, up)
        phase, begin = first * down % up, first * down // up
        part = windows[begin :: down][: len(ks)]
        out[first::up] = part @ np.ascontiguousarray(h[phase::up][::-1])
    return out


def mel_bank(rate: int, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters of equal width on the mel scale; (bins, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_window = np.hanning(FRAME).astype(np.float32)
_banks: dict[int, np.ndarray] = {}


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapped frames -> (log-mel energies in the precision in which they are stored, log energy); a recording shorter than a frame is padded to one."""
    if rate not in _banks:
        _banks[rate] = mel_bank(rate)
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = [], []
    for at in range(0, len(frames), PIECE):
        spectrum = np.fft.rfft(frames[at : at + PIECE] * _window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log10(np.maximum(power @ _banks[rate], 1e-8)).astype(HALF).astype(np.float32))
        energy.append(np.log10(np.maximum(power.sum(1), 1e-8)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """[start, end) of the frames from a rise above ``upper`` until a fall below ``lower``."""
    says = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    at = np.maximum.accumulate(np.where(says != 0, np.arange(len(says)), -1))
    on = np.concatenate([[False], (at >= 0) & (says[at] > 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def recording(payload: bytes, rate: int) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Log-mel frames, energy segments and the rate after resampling."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, UP, DOWN), rate * UP // DOWN)
    spread = float(energy.std())
    found = segments(energy, float(energy.mean()) + OPEN * spread, float(energy.mean()) + CLOSE * spread) if spread > 1e-6 else []
    return mel, found, rate * UP // DOWN


def digest(mel: np.ndarray, found: list[tuple[int, int]], rate: int) -> str:
    """A short text of the features: frames, segments, seconds within segments, mean and deviation of each band in hundredths."""
    level = np.rint(np.concatenate([mel.mean(0, dtype=np.float64), mel.std(0, dtype=np.float64)]) * 100).astype(int)
    inside = sum(b - a for a, b in found) * HOP / rate
    return f"frames={len(mel)};segments={len(found)};voiced={inside:.3f};mel=" + ",".join(map(str, level.tolist()))


_SPAN = [T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]
FEATURES = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType()),
    T.StructField("segments", T.ArrayType(T.StructType(_SPAN))),
    T.StructField("blocks", T.ArrayType(T.StructType([*_SPAN, T.StructField("features", T.BinaryType())]))),
]


def blocks(mel: np.ndarray, rate: int) -> list[dict]:
    out = []
    for at in range(0, len(mel), BLOCK):
        part = mel[at : at + BLOCK]
        full = np.zeros((BLOCK, MELS), HALF)
        full[: len(part)] = part
        out.append({"start_s": at * HOP / rate, "end_s": ((at + len(part) - 1) * HOP + FRAME) / rate, "features": full.tobytes()})
    return out


def audio_features(stored: DataFrame, media: str = "media", tensors: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features of the WAV files in ``media``, beside the columns ``keep``; without ``tensors`` the column ``blocks`` is left out.

    ``payload_sha256`` and ``tail_crc32`` (its last 64 bytes) are of the samples as read back.
    """
    fields = [f for f in FEATURES if tensors or f.name != "blocks"]
    rows = stored.select(*keep, media)
    schema = T.StructType([*(rows.schema[c] for c in keep), *fields])

    def make():
        def work(batch):
            for row in zip(*(batch[c] for c in keep), batch[media], strict=True):
                rate, payload = samples(row[-1])
                mel, found, rate = recording(payload, rate)
                spans = [{"start_s": a * HOP / rate, "end_s": ((b - 1) * HOP + FRAME) / rate} for a, b in found]
                out = (*row[:-1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), digest(mel, found, rate), spans)
                yield (*out, blocks(mel, rate)) if tensors else out

        return work

    return flat_map(rows, schema, make)


def digests(features: DataFrame, keep: tuple[str, ...], rate: int = RATE * UP // DOWN) -> DataFrame:
    """``keep`` and ``feature``, the digest of the tensors and segments as stored; ``rate`` is that after resampling."""
    ship(features.sparkSession)
    schema = T.StructType([*(features.schema[c] for c in keep), T.StructField("feature", T.StringType())])
    fields = to_arrow_schema(schema)

    def of(tensors: np.ndarray, spans: list[dict], found: list[dict]) -> str:
        frames = [round((s["end_s"] - s["start_s"]) * rate - FRAME) // HOP + 1 for s in spans]
        mel = np.concatenate([t[:n] for t, n in zip(tensors, frames, strict=True)]).astype(np.float32)
        return digest(mel, [(round(s["start_s"] * rate / HOP), round((s["end_s"] * rate - FRAME) / HOP) + 1) for s in found], rate)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                held = rows.column("blocks")
                inner, sizes = held.flatten(), pc.list_value_length(held).to_pylist()
                tensors = as_tensors(inner.field("features")).to_numpy_ndarray()
                spans = pa.StructArray.from_arrays([inner.field("start_s"), inner.field("end_s")], ["start_s", "end_s"]).to_pylist()
                out, begin = [], 0
                for n, found in zip(sizes, rows.column("segments").to_pylist(), strict=True):
                    out.append(of(tensors[begin : begin + n], spans[begin : begin + n], found))
                    begin += n
                yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(fields.field(c).type) for c in keep), pa.array(out, pa.string())], schema=fields)

    return features.select(*keep, "segments", "blocks").mapInArrow(run, schema)


def as_tensors(features: pa.Array | pa.ChunkedArray) -> pa.ExtensionArray:
    """Blocks' features (binaries of one length) as an Arrow array of fixed-shape tensors of half-precision floats."""
    if isinstance(features, pa.ChunkedArray):
        features = features.combine_chunks()
    fixed = features.cast(pa.binary(BLOCK * MELS * np.dtype(HALF).itemsize))
    values = pa.Array.from_buffers(pa.float16(), len(fixed) * BLOCK * MELS, [None, fixed.buffers()[1]], offset=fixed.offset * BLOCK * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), (BLOCK, MELS), dim_names=("frame", "mel")), pa.FixedSizeListArray.from_arrays(values, BLOCK * MELS))
