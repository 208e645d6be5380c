"""Waveform arrays: channels, crops, noise and spectra. Spectra use numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orpheon.functions.vectors import pad_or_truncate


def channels(waveform: Column, wanted: int, mode: str = "first", seed: int = 0, id: Column | None = None) -> Column:
    """`wanted` of the channels: the first ones, the mean of all, or one by a hash of the id; too few repeat the last."""
    n = F.size(waveform)
    if mode == "first":
        out = F.slice(waveform, 1, wanted)
    elif mode == "mix":
        total = F.aggregate(waveform, F.transform(waveform[0], lambda x: F.lit(0.0)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
        out = F.array(F.transform(total, lambda x: x / n))
    elif mode == "random":
        out = F.array(F.get(waveform, F.pmod(F.xxhash64(F.lit(seed), id if id is not None else F.lit(0)), n).cast("int")))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return F.concat(out, F.array_repeat(F.element_at(out, -1), F.greatest(F.lit(wanted) - F.size(out), F.lit(0))))


def crop(v: Column, size: int, start: Column | None = None, pad: bool = True) -> Column:
    """`size` samples from start (from 0), padded with zeros if asked."""
    cut = F.slice(v, (F.lit(1) if start is None else start.cast("int") + 1), size)
    return pad_or_truncate(cut, size) if pad else cut


def random_start(id: Column, total: Column, size: int, seed: int = 0) -> Column:
    """A start that a hash of the id fixes."""
    return F.when(total > size, F.pmod(F.xxhash64(F.lit(seed), id), total - size + 1)).otherwise(0)


def noisy(v: Column, snr_db: float, seed: int = 0) -> Column:
    """Gaussian noise at a signal-to-noise ratio; the same samples and seed give the same noise."""

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for a in x:
            a = np.asarray(a, np.float64)
            rng = np.random.default_rng([seed, len(a), int(np.abs(a).sum() * 1e6) & 0xFFFFFFFF])
            noise = rng.normal(size=len(a))
            power = (a * a).mean() / max((noise * noise).mean(), 1e-12) / 10 ** (snr_db / 10) if len(a) else 0.0
            out.append((a + noise * np.sqrt(power)).tolist())
        return pd.Series(out)

    return run(v)


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.pad(x, size // 2, mode="reflect") if len(x) > size // 2 else np.pad(x, size)
    n = 1 + (len(x) - size) // hop
    return np.lib.stride_tricks.sliding_window_view(x, size)[: n * hop : hop] * np.hanning(size + 1)[:-1]


def spectrogram(v: Column, n_fft: int = 64, hop: int = 16, power: float = 2.0) -> Column:
    """(frames x n_fft / 2 + 1) of a centred short-time Fourier transform with a Hann window."""

    @pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([(np.abs(np.fft.rfft(_frames(np.asarray(a, np.float64), n_fft, hop))) ** power).tolist() for a in x])

    return run(v)


def mel_filters(n_mels: int, n_fft: int, rate: float) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - f[None, :]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrogram(v: Column, rate: float, n_mels: int = 8, n_fft: int = 64, hop: int = 16) -> Column:
    filters = mel_filters(n_mels, n_fft, rate)

    @pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([((np.abs(np.fft.rfft(_frames(np.asarray(a, np.float64), n_fft, hop))) ** 2) @ filters.T).tolist() for a in x])

    return run(v)
