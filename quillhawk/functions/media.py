"""Windows, patches and features of audio and images."""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_RATE = 22_050
N_MFCC, N_FFT, HOP, N_MELS = 20, 2048, 512, 128
#: Image fusion: hue bins, saturation bins; brightness and saturation limits of the background.
HUE_BINS, SATURATION_BINS, BACKGROUND_V, BACKGROUND_S, LEAST_FOREGROUND = 12, 4, 230, 40, 200


def positions(n: Column, size: int, step: int, keep_last: bool = True) -> Column:
    """Starts of windows of ``size`` every ``step`` in ``n`` items; the last aligned window is added, one at 0 if n is small."""
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be positive")
    regular = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step))
    starts = F.array_distinct(F.array_append(regular, n - size)) if keep_last else regular
    return F.when(n <= size, F.array(F.lit(0))).otherwise(starts)


def audio_windows(df: DataFrame, id_col: str, signal_col: str, sample_rate: int, window_seconds: float = 1.0, hop_seconds: float = 0.5, keep_last: bool = True) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, start_sample, end_sample, start_second, end_second, padded, content)."""
    size, hop = int(sample_rate * window_seconds), int(sample_rate * hop_seconds)
    signal = F.coalesce(F.col(signal_col).cast("array<float>"), F.array().cast("array<float>"))
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), signal.alias("s")).select("doc_id", "s", F.posexplode(positions(F.size("s"), size, hop, keep_last)).alias("chunk_index", "start_sample"))
    cut = F.slice("s", F.col("start_sample") + 1, F.lit(size))
    padded = F.size(cut) < size
    content = F.when(padded, F.concat(cut, F.array_repeat(F.lit(0).cast("float"), F.lit(size) - F.size(cut)))).otherwise(cut)
    return rows.select(
        "doc_id", "chunk_index", F.concat("doc_id", F.lit("_audio_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "start_sample", (F.col("start_sample") + size).alias("end_sample"),
        (F.col("start_sample") / sample_rate).alias("start_second"), ((F.col("start_sample") + size) / sample_rate).alias("end_second"), padded.alias("padded"), content.alias("content"),
    )


def pre_emphasis(signal: Column, coefficient: float = 0.97) -> Column:
    """y[0] = x[0], y[n] = x[n] - c * x[n-1]."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(signal, 1, F.greatest(F.size(signal) - 1, F.lit(0))))
    return F.zip_with(signal, F.slice(before, 1, F.greatest(F.size(signal), F.lit(0))), lambda x, p: x - F.lit(coefficient) * p)


def clean_audio(signal: Column) -> Column:
    """Samples as floats, none for null; of several channels (an array of arrays) the mean of each moment."""
    return F.coalesce(signal.cast("array<float>"), F.array().cast("array<float>"))


def mixed_channels(channels: Column) -> Column:
    """The mean over channels at each moment, to the length of the shortest; none for null or no channels."""
    n = F.array_min(F.transform(channels, lambda c: F.size(c)))
    at = F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mean = lambda i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i).cast("double")) / F.size(channels)
    return F.transform(at, mean).cast("array<float>")


def patch_grid(df: DataFrame, id_col: str, width: str, height: str, patch: int = 224, stride: int = 112, keep_borders: bool = True) -> DataFrame:
    """(id, patch_index, x, y, padded): the patch corners, rows outer, columns inner.

    Patches of images smaller than one patch are to be padded; without ``keep_borders`` they are left out.
    """
    if not keep_borders:
        df = df.where((F.col(width) >= patch) & (F.col(height) >= patch))
    rows = df.select(id_col, width, height, F.explode(positions(F.col(height), patch, stride)).alias("y"))
    rows = rows.select(id_col, width, height, "y", F.explode(positions(F.col(width), patch, stride)).alias("x"))
    n_x = F.size(positions(F.col(width), patch, stride))
    index = (F.array_position(positions(F.col(height), patch, stride), F.col("y")) - 1) * n_x + F.array_position(positions(F.col(width), patch, stride), F.col("x")) - 1
    return rows.select(id_col, index.cast("int").alias("patch_index"), "x", "y", ((F.col(width) < patch) | (F.col(height) < patch)).alias("padded"))


def cut_patch(image: np.ndarray, x: int, y: int, patch: int) -> np.ndarray:
    """One patch, zero-padded to its full size."""
    part = image[y : y + patch, x : x + patch]
    out = np.zeros((patch, patch, *image.shape[2:]), dtype=image.dtype)
    out[: part.shape[0], : part.shape[1]] = part
    return out


def patch_pixels(height: Column, width: Column, data: Column, x: Column, y: Column, patch: int = 224) -> Column:
    """RGB bytes of one patch, zero-padded to its full size; null for null or wrongly sized data."""

    @F.pandas_udf("binary")
    def run(h: pd.Series, w: pd.Series, d: pd.Series, at_x: pd.Series, at_y: pd.Series) -> pd.Series:
        def one(a, b, raw, i, j):
            if raw is None or pd.isna(a) or pd.isna(b) or not len(raw) or len(raw) != int(a) * int(b) * 3:
                return None
            return cut_patch(np.frombuffer(raw, dtype=np.uint8).reshape(int(a), int(b), 3), int(i), int(j), patch).tobytes()

        return pd.Series([one(*r) for r in zip(h, w, d, at_x, at_y)])

    return run(height, width, data, x, y)


def grid_descriptors(image: np.ndarray, tile: int = 16, floor: float = 1e-6) -> np.ndarray:
    """Gradient descriptors (128 components) of the tiles of a grey image, a stand-in where no key-point detector is installed.

    A tile is divided into 4 x 4 cells with eight directions each; tiles without any gradient give none, so a flat image
    has no descriptors.
    """
    x = image.astype(np.float64)
    rows, columns = x.shape[0] // tile, x.shape[1] // tile
    if not rows or not columns:
        return np.zeros((0, 128))
    down, right = np.gradient(x)
    size = np.hypot(down, right)[: rows * tile, : columns * tile]
    turn = np.floor((np.arctan2(down, right)[: rows * tile, : columns * tile] + np.pi) / (2 * np.pi) * 8).astype(np.int64) % 8
    i, j = np.indices(size.shape)
    cell = tile // 4
    place = ((i // tile) * columns + j // tile) * 128 + ((i % tile) // cell * 4 + (j % tile) // cell) * 8 + turn
    out = np.bincount(place.ravel(), weights=size.ravel(), minlength=rows * columns * 128).reshape(-1, 128)
    return out[out.sum(axis=1) > floor]


def grey(image: np.ndarray) -> np.ndarray:
    """Luminance of a three-channel image taken as BGR; one channel is squeezed, others pass."""
    if image.ndim == 3 and image.shape[2] == 3:
        return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
    return image[:, :, 0] if image.ndim == 3 and image.shape[2] == 1 else image


def hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit HSV with half hue degrees."""
    x = rgb.astype(np.float64)
    top, low = x.max(axis=-1), x.min(axis=-1)
    span = top - low
    safe = np.where(span == 0, 1, span)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(span == 0, 0, hue % 360) / 2
    sat = np.where(top == 0, 0, span / np.where(top == 0, 1, top)) * 255
    return np.stack([np.rint(hue) % 180, np.rint(sat), top], axis=-1)


def hsv_histogram(rgb: np.ndarray) -> np.ndarray:
    """Hue and saturation histogram of the foreground, at unit length."""
    x = hsv(rgb)
    front = ~((x[..., 2] > BACKGROUND_V) & (x[..., 1] < BACKGROUND_S))
    if front.sum() < LEAST_FOREGROUND:
        front = np.ones(front.shape, dtype=bool)
    h = np.histogram(x[..., 0][front], bins=HUE_BINS, range=(0, 180))[0]
    s = np.histogram(x[..., 1][front], bins=SATURATION_BINS, range=(0, 256))[0]
    out = np.concatenate([h, s]).astype(np.float32)
    n = np.linalg.norm(out)
    return out / n if n else out


def color_histograms(height: Column, width: Column, data: Column) -> Column:
    """Colour histograms of RGB bytes, an array of 16 floats; null or wrongly sized data gives null."""

    @F.pandas_udf("array<float>")
    def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b, raw):
            if raw is None or pd.isna(a) or pd.isna(b) or len(raw) != int(a) * int(b) * 3 or not len(raw):
                return None
            return hsv_histogram(np.frombuffer(raw, dtype=np.uint8).reshape(int(a), int(b), 3))

        return pd.Series([one(*x) for x in zip(h, w, d)])

    return run(height, width, data)


def descriptors(height: Column, width: Column, data: Column, detect, root: bool = True) -> Column:
    """Local descriptors of RGB bytes by a detector (grey image -> rows), as roots of their shares; no detector is an error."""
    if detect is None:
        raise ValueError("no key-point detector is installed; pass one, or start from a descriptor table")

    @F.pandas_udf("array<array<float>>")
    def run(h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b, raw):
            if raw is None or len(raw) != int(a) * int(b) * 3:
                return []
            found = np.asarray(detect(grey(np.frombuffer(raw, dtype=np.uint8).reshape(int(a), int(b), 3))), dtype=np.float64)
            if not found.size:
                return []
            return [list(map(float, x)) for x in (np.sqrt(found / (found.sum(axis=1, keepdims=True) + 1e-7)) if root else found)]

        return pd.Series([one(*x) for x in zip(h, w, d)])

    return run(height, width, data)


@lru_cache(maxsize=4)
def mel_filters(sample_rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, of equal area."""

    def to_mel(f: np.ndarray) -> np.ndarray:
        return np.where(f < 1000, f / (200 / 3), 15 + np.log(np.maximum(f, 1000) / 1000) / (np.log(6.4) / 27))

    def to_hz(m: np.ndarray) -> np.ndarray:
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((np.log(6.4) / 27) * (np.maximum(m, 15) - 15)))

    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(sample_rate / 2)), n_mels + 2))
    freq = np.linspace(0, sample_rate / 2, n_fft // 2 + 1)
    up = (freq[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freq[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(signal: np.ndarray, sample_rate: int = SAMPLE_RATE, n_mfcc: int = N_MFCC, n_fft: int = N_FFT, hop: int = HOP, n_mels: int = N_MELS, emphasis: float = 0.97) -> np.ndarray:
    """(frames, n_mfcc) cepstral coefficients; a signal shorter than one transform gives no frames.

    Centred frames padded with zeros, Hann window, power spectrum, Slaney mel bands, decibels to 80 below the loudest,
    orthonormal cosine transform.
    """
    if not (1 <= n_mfcc <= n_mels and sample_rate >= 1 and n_fft >= 1 and hop >= 1 and 0 <= emphasis < 1):
        raise ValueError("invalid parameters")
    x = np.zeros(0) if signal is None else np.asarray(signal, dtype=np.float64)
    if len(x) < n_fft:
        return np.zeros((0, n_mfcc), dtype=np.float32)
    x = np.append(x[0], x[1:] - emphasis * x[:-1])
    x = np.pad(x, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    bands = 10 * np.log10(np.maximum(power @ mel_filters(sample_rate, n_fft, n_mels).T, 1e-10))
    bands = np.maximum(bands, bands.max() - 80)
    k = np.arange(n_mels)
    basis = np.sqrt(2 / n_mels) * np.cos(np.pi * np.arange(n_mfcc)[:, None] * (2 * k + 1) / (2 * n_mels))
    basis[0] /= np.sqrt(2)
    return (bands @ basis.T).astype(np.float32)


def mfcc_frames(signal: Column, sample_rate: int = SAMPLE_RATE, n_mfcc: int = N_MFCC) -> Column:
    """Frames of a signal as an array of arrays."""

    @F.pandas_udf("array<array<float>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [list(f) for f in mfcc(x, sample_rate, n_mfcc)])

    return run(signal)


def frame_statistics(frames: Column, n_mfcc: int = N_MFCC) -> Column:
    """Means and population deviations of the coefficients; no frames give zeros."""

    def stats(i: Column) -> Column:
        values = F.transform(frames, lambda f: F.get(f, i).cast("double"))
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
        return F.struct(mean.alias("m"), F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n).alias("s"))

    each = F.transform(F.sequence(F.lit(0), F.lit(n_mfcc - 1)), stats)
    both = F.concat(F.transform(each, lambda t: t["m"]), F.transform(each, lambda t: t["s"]))
    return F.when(F.size(frames) > 0, both).otherwise(F.array_repeat(F.lit(0.0), 2 * n_mfcc))


def mfcc_names(n_mfcc: int = N_MFCC) -> list[str]:
    return [f"mfcc_{i}_{s}" for s in ("media", "std") for i in range(n_mfcc)]


def tone(frequency: Column, samples: int, sample_rate: int = SAMPLE_RATE, amplitude: float = 0.5, wobble: float = 0.0) -> Column:
    """A sine of ``samples`` values, its frequency swinging by ``wobble`` twice a second's half."""

    def value(i: Column) -> Column:
        t = i / F.lit(float(sample_rate))
        f = frequency + F.lit(wobble) * F.sin(F.lit(2 * np.pi * 0.5) * t)
        return F.lit(amplitude) * F.sin(F.lit(2 * np.pi) * f * t)

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), value)


def noise(seed: Column, samples: int, amplitude: float = 0.5) -> Column:
    """``samples`` values spread evenly over -amplitude..amplitude, the same for the same seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1) * F.lit(amplitude))


def encode_wav(samples: np.ndarray, sample_rate: int = SAMPLE_RATE) -> bytes:
    """Sixteen-bit mono WAV bytes of samples in -1..1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_wav(raw: bytes, max_seconds: float | None = None, target_rate: int = SAMPLE_RATE) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 of PCM WAV bytes (8, 16 or 32 bit), resampled linearly to ``target_rate``."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        n = w.getnframes() if max_seconds is None else min(w.getnframes(), int(rate * max_seconds))
        data = w.readframes(n)
    if width not in (1, 2, 4):
        raise ValueError(f"{8 * width} bit samples are not supported")
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}[width]
    x = np.frombuffer(data, dtype=kind).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if rate != target_rate and len(x):
        at = np.arange(int(len(x) * target_rate / rate)) * (rate / target_rate)
        x = np.interp(at, np.arange(len(x)), x).astype(np.float32)
    return x, target_rate


def wav_samples(raw: Column, max_seconds: float | None = None) -> Column:
    """Samples of WAV bytes; bytes that cannot be decoded give null."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return decode_wav(b, max_seconds)[0]
            except (ValueError, EOFError, wave.Error, TypeError):
                return None

        return s.map(one)

    return run(raw)
