"""Signal features as Arrow-batched pandas functions around small numpy kernels.

Frames are ``nperseg`` samples every ``hop``; a recording is one row with an
array of samples, so Spark deals recordings to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NPERSEG, HOP = 512, 256


def spectrogram(x: np.ndarray, rate: float, nperseg: int = NPERSEG, hop: int = HOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, times, magnitudes): Hann window, each frame less its mean, power scaled by the window's sum."""
    x = np.asarray(x, np.float64)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    n = max(0, (len(x) - nperseg) // hop + 1)
    f = np.fft.rfftfreq(nperseg, 1 / rate)
    if not n:
        return f, np.zeros(0), np.zeros((len(f), 0))
    frames = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop][:n]
    frames = (frames - frames.mean(axis=1, keepdims=True)) * window
    return f, (np.arange(n) * hop + nperseg / 2) / rate, (np.abs(np.fft.rfft(frames, axis=1)) / window.sum()).T


def mel_bank(rate: float, nperseg: int, n_mels: int) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mel; (n_mels, frequencies)."""
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(nperseg, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_db(x: np.ndarray, rate: float, nperseg: int = NPERSEG, hop: int = HOP, n_mels: int = 40, floor: float = 1e-10, span: float = 80.0) -> np.ndarray:
    """Mel power in decibels, at most ``span`` below its peak; (n_mels, frames)."""
    power = (spectrogram(x, rate, nperseg, hop)[2] * (nperseg // 2)) ** 2
    db = 10 * np.log10(np.maximum(floor, mel_bank(rate, nperseg, n_mels) @ power))
    return np.maximum(db, db.max() - span) if db.size else db


def mfcc(mel: np.ndarray, n: int = 13, standardise: bool = True) -> np.ndarray:
    """Orthonormal cosine transform of mel decibels; rows standardised."""
    k = mel.shape[0]
    basis = np.sqrt(2 / k) * np.cos(np.pi / k * (np.arange(k) + 0.5) * np.arange(n)[:, None])
    basis[0] /= np.sqrt(2)
    out = basis @ mel
    if standardise and out.size:
        s = out.std(axis=1, keepdims=True)
        out = (out - out.mean(axis=1, keepdims=True)) / np.where(s > 0, s, 1)
    return out


def band_pass(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Frequencies outside [low, high] set to zero."""
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
    spectrum[(f < low) | (f > high)] = 0
    return np.fft.irfft(spectrum, len(x))


def quiet_runs(x: np.ndarray, window: int, threshold: float, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` samples whose frames of ``window`` have a root mean square under ``threshold``."""
    n = len(x) // window
    rms = np.sqrt((np.asarray(x[: n * window], float).reshape(n, window) ** 2).mean(axis=1)) if n else np.zeros(0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (rms < threshold).astype(int), [0]])))
    return [(int(a) * window, int(b) * window) for a, b in zip(edge[::2], edge[1::2]) if (b - a) * window >= least]


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian filter that reaches four deviations; the ends are mirrored."""
    reach = int(4 * sigma + 0.5)
    if not reach or not len(x):
        return x
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def thumbnail_start(x: np.ndarray, rate: float, *, seconds: float = 1.0, search: float = 10.0, sigma: float = 0.25, nperseg: int = NPERSEG, hop: int = HOP) -> float:
    """Where a clip of ``seconds`` starts whose middle is the loudest moment of the first ``search`` seconds.

    Loudness is the spectrum's sum over time, smoothed by ``sigma`` seconds; the
    last ``seconds`` of it don't count, so that the clip is whole.
    """
    f, t, s = spectrogram(np.asarray(x[: int(search * rate)], float), rate, nperseg, hop)
    if len(t) < 2:
        return 0.0
    per_second = 1 / (t[1] - t[0])
    loud = smoothed(s.sum(axis=0), sigma * per_second)
    middles = loud[: max(1, len(loud) - int(seconds * per_second))]  # those with a clip's time left after them
    begin = int(np.argmax(middles)) / per_second - seconds / 2
    return min(max(begin, 0.0), len(x) / rate)


def quiet(samples: Column, window: int, threshold: float, least: int) -> Column:
    """``quiet_runs`` of each row's samples: array of {start, end}."""

    @F.arrow_udf("array<struct<start:long,end:long>>")
    def found(batch: pa.Array) -> pa.Array:
        runs = [quiet_runs(x.values.to_numpy(zero_copy_only=False), window, threshold, least) if x.is_valid else [] for x in batch]
        return pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return found(samples.cast("array<double>"))


def spectra(samples: Column, rate: float, nperseg: int = NPERSEG, hop: int = HOP) -> Column:
    """Magnitudes of each row's ``spectrogram``: an array of frames, each an array of frequencies."""

    @F.arrow_udf("array<array<double>>")
    def found(batch: pa.Array) -> pa.Array:
        made = [spectrogram(x.values.to_numpy(zero_copy_only=False), rate, nperseg, hop)[2].T.tolist() if x.is_valid else None for x in batch]
        return pa.array(made, pa.list_(pa.list_(pa.float64())))

    return found(samples.cast("array<double>"))


def mel_features(recordings: DataFrame, rate: float, *, id_col: str = "id", samples_col: str = "samples", n_mels: int = 40) -> DataFrame:
    """id and mel: one array of decibels for each band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "mel": [mel_db(np.asarray(x, float), rate, n_mels=n_mels).tolist() for x in b["samples"]]})

    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(samples_col).cast("array<double>").alias("samples"))
    return rows.mapInPandas(run, "id long, mel array<array<double>>")


def thumbnails(recordings: DataFrame, rate: float, *, id_col: str = "id", samples_col: str = "samples", **options) -> DataFrame:
    """id and start: seconds at which each recording's thumbnail starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "start": [thumbnail_start(np.asarray(x, float), rate, **options) for x in b["samples"]]})

    rows = recordings.select(F.col(id_col).alias("id"), F.col(samples_col).cast("array<double>").alias("samples"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, start double").withColumnRenamed("id", id_col)


def frames(df: DataFrame, value: str, order: str, key: str, size: int) -> DataFrame:
    """Sliding frames of rows by key: the relational form of ``functions.arrays.patches``."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, size - 1)
    return df.withColumn("frame", F.collect_list(value).over(w)).where(F.size("frame") == size)
