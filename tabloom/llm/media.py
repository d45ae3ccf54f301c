"""Audio columns: lossless 8-bit WAV bytes, polyphase resampling, log-mel spans and energy segments.

An audio value is a mono WAV file of unsigned 8-bit samples at `rate` Hz. Features come from the
stored bytes: the samples are resampled by a rational factor with a windowed-sinc polyphase filter,
cut into overlapped frames, and turned into log-mel filterbank energies. A hysteresis on the frame
energy finds segments: one opens when the energy reaches the upper threshold and closes when it
falls below the lower. The filterbank is stored as tensors of one fixed shape (frames x bands, the
last padded with the floor value), each with its time span, so that a column of them is an Arrow
fixed-shape tensor column.

Defined results: null and empty texts give the shortest payload; a recording that does not end with
a frame is padded with silence to the end of one, so that every sample is in a frame; silence has no segments; equal bytes give equal features, in any batch.
Long recordings are framed in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_schema, batch_of, pieces_of, texts_of

RATE, UP, DOWN = 16_000, 3, 4  # 16 kHz becomes 12 kHz
WINDOW, HOP, FFT, BANDS = 300, 120, 512, 32  # 25 ms every 10 ms at 12 kHz
SPAN_FRAMES = 64
FLOOR = -10.0
OPEN, CLOSE = 0.16, 0.12  # of full scale, root mean square
UNIT = 192
BLOCK = 1 << 18


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as the unsigned 8-bit samples of a mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is needed")
        return f.readframes(f.getnframes())


def payload_of(text: str) -> tuple[bytes, int]:
    """The text's UTF-8 bytes filled up with blanks to a positive multiple of UNIT, and their number before."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def polyphase_bank(up: int = UP, down: int = DOWN, half: int = 8) -> tuple[np.ndarray, int]:
    """One column of filter taps for each of the `up` phases, over a common window of input samples."""
    reach = half * max(up, down) / up  # in input samples, at the lower of the two rates
    width = int(np.ceil(reach)) * 2 + down
    at = np.arange(width)[:, None] - (np.arange(up)[None, :] * down / up + int(np.ceil(reach)))
    cut = min(1.0, up / down)
    taps = cut * np.sinc(cut * at) * np.where(np.abs(at) < reach, 0.5 + 0.5 * np.cos(np.pi * at / reach), 0)
    return (taps / taps.sum(axis=0)).astype(np.float32), int(np.ceil(reach))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up/down times its rate: each group of `down` input samples gives one sample of each phase."""
    bank, reach = polyphase_bank(up, down)
    groups = -(-len(x) // down)
    padded = np.zeros(groups * down + len(bank), np.float32)
    padded[reach : reach + len(x)] = x
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(bank))[::down][:groups]
    return np.concatenate([windows[i : i + BLOCK // down] @ bank for i in range(0, groups, BLOCK // down)]).ravel()[: -(-len(x) * up // down)]


def mel_bank(rate: float, fft: int = FFT, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, over the bins of a real FFT."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_BANK = mel_bank(RATE * UP / DOWN)
_TAPER = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 mel energies [frames, BANDS] of overlapped windows, and each frame's root mean square."""
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mel, power = [], []
    for i in range(0, len(frames), 1024):
        block = frames[i : i + 1024]
        power.append(np.sqrt((block * block).mean(axis=1)))
        spectrum = np.fft.rfft(block * _TAPER, FFT)
        mel.append(np.log10((spectrum.real**2 + spectrum.imag**2) @ _BANK + np.float32(10**FLOOR)))
    return np.concatenate(mel).astype(np.float32), np.concatenate(power)


def hysteresis(power: np.ndarray, upper: float = OPEN, lower: float = CLOSE) -> np.ndarray:
    """[start, end) frames of the segments: open at `upper`, closed below `lower`."""
    said = np.where(power >= upper, 1, np.where(power < lower, 0, -1))
    last = np.maximum.accumulate(np.where(said >= 0, np.arange(len(said)), -1))
    on = np.where(last >= 0, said[last], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edges.reshape(-1, 2)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Tensors [spans, SPAN_FRAMES, BANDS], their spans in seconds, the segments in seconds, and the samples read."""
    payload = from_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x)
    mel, power = log_mel(np.pad(x, (0, -(len(x) - WINDOW) % HOP if len(x) > WINDOW else 0)))
    spans = -(-len(mel) // SPAN_FRAMES)
    tensor = np.full((spans * SPAN_FRAMES, BANDS), FLOOR, np.float32)
    tensor[: len(mel)] = mel
    step = HOP * DOWN / (RATE * UP)
    starts = np.arange(spans) * SPAN_FRAMES
    times = np.stack([starts, np.minimum(starts + SPAN_FRAMES, len(mel))], axis=1) * step
    return tensor.reshape(spans, SPAN_FRAMES, BANDS), times, hysteresis(power) * step, payload


def tensor_array(flat: pa.Array) -> pa.Array:
    """A column of flattened tensors as an Arrow fixed-shape tensor array."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SPAN_FRAMES, BANDS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), SPAN_FRAMES * BANDS))


def audio_spans(table: DataFrame, media_col="media", id_col="doc_id") -> DataFrame:
    """A row for each span: id, span number, start_s, end_s and the tensor, row-major. Null media give no row."""
    ddl = "doc_id bigint, span int, start_s double, end_s double, tensor array<float>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if media is not None:
                    tensor, times, _, _ = features(media)
                    for i in range(0, len(tensor), 256):
                        part = tensor[i : i + 256]
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part[0].size), pa.array(part.ravel()))
                        yield batch_of(schema, [doc_id] * len(part), np.arange(i, i + len(part)), times[i : i + 256, 0], times[i : i + 256, 1], flat)

    return texts_of(table, F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, ddl)


def with_audio(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes (of the text alone) and media (the WAV file that holds its padded UTF-8 bytes)."""
    ddl = "doc_id bigint, n_bytes bigint, media binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                held = [payload_of(t) for t in texts.to_pylist()]
                yield batch_of(schema, part.column(0), [n for _, n in held], [to_wav(p) for p, _ in held])

    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_spans int, n_segments int, active_s double, feature string"


def audio_digest(table: DataFrame) -> DataFrame:
    """Of each stored file (doc_id, n_bytes, media): digests of what is read back and of its features.

    feature is the SHA-256 of the tensors (in steps of 1/256), their spans and the segments.
    """
    schema = arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*(batch.column(i) for i in range(3)), strict=True):
                media = media.as_py()
                tensor, times, segments, payload = features(media)
                seen = hashlib.sha256(np.round(tensor * 256).astype("<i2").tobytes())
                seen.update(np.round(times * 1000).astype("<i8").tobytes() + np.round(segments * 1000).astype("<i8").tobytes())
                rows.append((doc_id.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), len(tensor), len(segments), float((segments[:, 1] - segments[:, 0]).sum()), seen.hexdigest()))
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))

    return texts_of(table, "*").mapInArrow(run, DIGEST)
