"""Signal features of recordings, by versioned extractors that run on Arrow batches of array columns.

A recording is a row with an array of samples and a sampling rate; an extractor is a function of both
that returns named numbers. Rows whose extraction fails come back with nulls and the reason in `error`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp as D

Extractor = Callable[[np.ndarray, float], dict[str, float]]
#: Frequencies of mel rows: each third of them is a band, and all together are one.
BANDS = ("low", "mid", "high", "all")


def _bands(rows: np.ndarray) -> list[np.ndarray]:
    n = len(rows)
    return [rows[: n // 3], rows[n // 3 : 2 * n // 3], rows[2 * n // 3 :], rows]


def _spread(name: str, values: np.ndarray, quantiles: tuple[float, ...] = (75, 90)) -> dict[str, float]:
    return {f"{name}_mean": values.mean(), **{f"{name}_p{q:g}": np.percentile(values, q) for q in quantiles}, f"{name}_max": values.max()}


def global_features(raw: np.ndarray, x: np.ndarray, rate: float) -> dict[str, float]:
    n = len(x)
    d = x - x.mean()
    m2 = float((d * d).mean())
    skew = float((d**3).mean()) / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 and m2 > 0 else 0.0
    return {"mean": raw.mean(), "std": x.std(), "duration": len(raw) / rate, "skewness": skew, "kurtosis": D.kurtosis(x, unbiased=True), "zcr": D.crossings(x)}


def band_features(power: np.ndarray) -> dict[str, float]:
    """Per band: spread and kurtosis of its decibels, share of power, peak over mean, entropy of its frames."""
    db, out, total = D.decibels(power), {}, max(float(power.sum()), D.EPS)
    for name, p, level in zip(BANDS, _bands(power), _bands(db), strict=True):
        series = p.sum(0)
        share = series / max(float(series.sum()), D.EPS)
        out |= {f"band_{name}_std": level.std(), f"band_{name}_share": p.sum() / total, f"band_{name}_kurtosis": D.kurtosis(level.reshape(-1)), f"band_{name}_peak": series.max() / max(float(series.mean()), D.EPS), f"band_{name}_entropy": -(share[share > 0] * np.log(share[share > 0])).sum()}
    return out


def impulse_features(power: np.ndarray, frame_rate: float) -> dict[str, float]:
    """Kurtosis, crest and impulse of each band's level in windows of one second, half overlapping."""
    out: dict[str, float] = {}
    for name, p in zip(BANDS, _bands(power), strict=True):
        w = D.frames(np.sqrt(p.sum(0)), round(frame_rate), round(frame_rate / 2))
        for kind, f in (("kurtosis", D.kurtosis), ("crest", D.crest), ("impulse", D.impulse)):
            out |= _spread(f"window_{name}_{kind}", f(w))
    return out


def shock_features(power: np.ndarray, frame_rate: float) -> dict[str, float]:
    """Shocks in the energy-normalised level of each band, against its robust scale."""
    level, out = D.pcen(power, frame_rate), {}
    for name, rows in zip(BANDS, _bands(level), strict=True):
        s = rows.mean(0)
        scale, seconds = D.robust_scale(s), len(s) / frame_rate
        above = s > np.median(s) + 4 * scale
        _, prominence = D.peaks(s, 1.5 * scale, max(1, round(0.02 * frame_rate)))
        windows = D.impulse(D.frames(s, round(frame_rate), round(frame_rate / 2)))
        out |= {
            f"shock_{name}_impulse": D.impulse(s), f"shock_{name}_crest": D.crest(s), f"shock_{name}_kurtosis": D.kurtosis(s, excess=True, unbiased=True), f"shock_{name}_p95": np.percentile(s, 95),
            f"shock_{name}_episodes": (np.diff(np.append(0, above.astype(int))) == 1).sum() / seconds, f"shock_{name}_peaks": len(prominence) / seconds, f"shock_{name}_prominence": prominence.mean() if len(prominence) else 0.0,
            f"shock_{name}_window_mean": windows.mean(), f"shock_{name}_window_p90": np.percentile(windows, 90), f"shock_{name}_window_max": windows.max(),
        }
    return out


def wavelet_features(x: np.ndarray, rate: float, level: int = 5) -> dict[str, float]:
    """Kurtosis, zero crossings and spread of each wavelet band in windows of one second."""
    out: dict[str, float] = {}
    bands = D.wavelet(x, level)
    for k in range(level + 1):
        c = bands[k] if k < len(bands) else np.zeros(1)
        own = rate / 2 ** (level if k == 0 else level + 1 - k)
        w = D.frames(c, round(own), round(own / 2))
        for kind, f in (("kurtosis", D.kurtosis), ("zcr", D.crossings), ("std", lambda v: v.std(-1))):
            out |= _spread(f"dwt_{k}_{kind}", f(w), (90,))
    return out


def tick_features(raw: np.ndarray, rate: float) -> dict[str, float]:
    """Envelope kurtosis and crest of a high and a low band in windows of half a second, and their balance."""
    x, out, means = raw - raw.mean(), {}, {}
    for name, low, high in (("hi", 7000.0, 9500.0), ("lo", 500.0, 5000.0)):
        band = D.envelope(D.zero_phase(x, rate, low, min(high, 0.49 * rate))) if low < 0.45 * rate else np.zeros(len(x))
        w = D.frames(band, round(rate / 2), round(rate / 4))
        kurtosis, crest = D.kurtosis(w, excess=True), D.crest(w)
        means[name] = kurtosis.mean()
        out |= {f"tick_{name}_kurtosis_mean": kurtosis.mean(), f"tick_{name}_kurtosis_max": kurtosis.max(), f"tick_{name}_crest_mean": crest.mean()}
    balance = means["hi"] / (abs(means["hi"]) + abs(means["lo"]) + 1e-9)
    return out | {"tick_balance": balance, "tick_hi_crest_max": crest.max()}


def modulation_features(x: np.ndarray, rate: float, power: np.ndarray, frame_rate: float) -> dict[str, float]:
    """Chatter in the envelope's spectrum, and how mel rows move together."""
    step = max(1, round(rate / 1000))
    e = D.envelope(np.pad(x, (0, max(0, 2 * step - len(x)))))
    e = e[: len(e) // step * step].reshape(-1, step).mean(1)
    e = (e - e.mean()) * np.hanning(len(e))
    spectrum, f = np.abs(np.fft.rfft(e)) ** 2, np.fft.rfftfreq(len(e), step / rate)
    total = max(float(spectrum[f >= 1].sum()), D.EPS)
    share = lambda a, b: spectrum[(f >= a) & (f < b)].sum() / total
    series = np.log(power + 1e-10)
    series = series - series.mean(1, keepdims=True)
    moving = np.abs(np.fft.rfft(series * np.hanning(series.shape[1]), axis=1)) ** 2
    mf = np.fft.rfftfreq(series.shape[1], 1 / frame_rate)
    own = moving[:, (mf >= 1) & (mf <= 40)]
    if not own.shape[1]:
        own = moving[:, :1]
    peak = own.argmax(1).astype(float) + 1
    height = 10 * np.log10((own.max(1) + D.EPS) / (np.median(own, 1) + D.EPS))
    norm = np.sqrt((series**2).sum(1)) + D.EPS
    near = (series[1:] * series[:-1]).sum(1) / (norm[1:] * norm[:-1])
    return {
        "chatter_80_200": share(80, 200), "chatter_200_300": share(200, 300), "modulation_peak_mean": height.mean(), "modulation_peak_max": height.max(),
        "modulation_sync": float(np.clip(1 - peak.std() / max(peak.mean(), D.EPS), 0, 1)), "modulation_neighbours": near.mean(),
    }


def burst_features(x: np.ndarray) -> dict[str, float]:
    """Kurtosis over 4 in sliding windows of the finest but one wavelet band: how often, and for how long."""
    bands = D.wavelet(x, 4)
    k = D.kurtosis(D.frames(bands[max(0, len(bands) - 2)], 256, 64))
    return {"burst_fraction": (k > 4).mean(), "burst_longest": D.longest_true(k > 4) / len(k), "burst_kurtosis": k.max()}


def low_features(x: np.ndarray, rate: float) -> dict[str, float]:
    """The band from 20 to 312 Hz."""
    band = D.zero_phase(x.astype(np.float64), rate, 20.0, min(312.0, 0.45 * rate))
    e = D.envelope(band)
    w = D.frames(e, round(rate / 2), round(rate / 4))
    depth = (w.max(1) - w.min(1)) / np.maximum(w.max(1) + w.min(1), D.EPS)
    spectrum, f = np.abs(np.fft.rfft(band)) ** 2, np.fft.rfftfreq(len(band), 1 / rate)
    own = (f >= 20) & (f <= 312)
    p, f = spectrum[own], f[own]
    if not len(p):
        p, f = np.ones(1), np.zeros(1)
    share = p / max(float(p.sum()), D.EPS)
    zcr = D.crossings(D.frames(band, round(rate / 2), round(rate / 4)))
    positive = share[share > 0]
    return {
        "low_energy": float((band**2).sum()) / max(float((x.astype(np.float64) ** 2).sum()), D.EPS), "low_depth_mean": depth.mean(), "low_depth_p90": np.percentile(depth, 90), "low_depth_max": depth.max(), "low_peak": share.max(), "low_peak_hz": f[share.argmax()],
        "low_entropy": -(positive * np.log(positive)).sum() / np.log(max(len(share), 2)), "low_centroid": (share * f).sum(), "low_zcr_cv": zcr.std() / max(float(zcr.mean()), D.EPS), "low_crest": D.crest(band),
    }


def extract_full(raw: np.ndarray, rate: float) -> dict[str, float]:
    """All blocks: 195 numbers."""
    raw = raw[np.isfinite(raw)].astype(np.float64)
    if not len(raw):
        raise ValueError("no finite samples")
    x = D.preprocess(raw, rate)
    power, frame_rate = D.mel_bank(rate) @ D.stft_power(x), rate / 128
    x64 = x.astype(np.float64)
    return (
        global_features(raw, x64, rate) | band_features(power) | impulse_features(power, frame_rate) | shock_features(power, frame_rate) | wavelet_features(x64, rate)
        | tick_features(raw, rate) | modulation_features(x64, rate, power, frame_rate) | burst_features(x64) | low_features(x, rate)
    )


def extract_basic(raw: np.ndarray, rate: float) -> dict[str, float]:
    """The global numbers only."""
    raw = raw[np.isfinite(raw)].astype(np.float64)
    return global_features(raw, D.preprocess(raw, rate).astype(np.float64), rate)


EXTRACTORS: dict[str, Extractor] = {"full": extract_full, "basic": extract_basic}


def names_of(version: str) -> list[str]:
    """The numbers that an extractor gives, by trying it on a second of noise."""
    return list(EXTRACTORS[version](np.random.default_rng(0).normal(size=22050), 22050.0))


def with_features(recordings: DataFrame, version: str = "full", signal: str = "signal", rate: str = "sampling_rate") -> DataFrame:
    """recordings without their signal, with one column per feature and `error`. Filter before: nothing is pushed below this."""
    names, kept, f = names_of(version), [c for c in recordings.columns if c != signal], EXTRACTORS[version]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = np.full((batch.num_rows, len(names)), np.nan), []
            for k, (x, sr) in enumerate(zip(batch.column(signal), batch.column(rate).to_pylist(), strict=True)):
                try:
                    found = f(np.asarray(x.values, np.float64), float(sr))
                    values[k] = [found[n] for n in names]
                    errors.append(None)
                except (AttributeError, TypeError, ValueError, IndexError, KeyError) as e:
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            columns = [pa.array(values[:, j], mask=np.isnan(values[:, j])) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns, pa.array(errors, pa.string())], [*kept, *names, "error"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in recordings.schema if c.name != signal), *(f"`{n}` double" for n in names), "error string"])
    return recordings.mapInArrow(run, schema)


AUGMENTATIONS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {}


def _augmentation(f: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    AUGMENTATIONS[f.__name__] = f
    return f


def _stretched(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)


@_augmentation
def gaussian_noise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """At a signal-to-noise ratio of 18 to 35 dB."""
    return x + rng.normal(0, np.sqrt((x * x).mean() / 10 ** (rng.uniform(18, 35) / 10)), len(x))


@_augmentation
def white_noise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return x + rng.normal(0, x.std() * rng.uniform(0.001, 0.02) + D.EPS, len(x))


@_augmentation
def crop(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    cut = int(len(x) * rng.uniform(0.01, 0.1))
    start = rng.integers(0, cut + 1)
    return _stretched(x[start : len(x) - cut + start], len(x))


@_augmentation
def insert(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    size = max(1, int(len(x) * rng.uniform(0.01, 0.1)))
    source, place = rng.integers(0, len(x) - size + 1, 2)
    return np.insert(x, place, x[source : source + size])[: len(x)]


@_augmentation
def gain(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return x * rng.uniform(0.85, 1.15)


@_augmentation
def stretch(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return x[np.minimum((np.arange(len(x)) * rng.uniform(0.9, 1.1)).astype(np.int64), len(x) - 1)]


@_augmentation
def echo(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    delay = min(len(x) - 1, max(1, int(len(x) * rng.uniform(0.001, 0.02))))
    return x + rng.uniform(0.1, 0.4) * np.concatenate([np.zeros(delay), x[:-delay]])


@_augmentation
def mask(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A band of frequencies and a stretch of time, weakened."""
    spectrum = np.fft.rfft(x)
    n = len(spectrum)
    start, width = rng.integers(0, n), max(1, n // 20)
    spectrum[start : start + width] *= 0.1
    y = np.fft.irfft(spectrum, len(x))
    at = rng.integers(0, len(x))
    y[at : at + max(1, len(x) // 50)] *= 0.1
    return y


@_augmentation
def speed(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    y = _stretched(x, max(2, int(len(x) / rng.uniform(0.9, 1.1))))
    return y[: len(x)] if len(y) >= len(x) else np.pad(y, (0, len(x) - len(y)), mode="edge")


def augmented(recordings: DataFrame, methods: list[str], count: int, key: str = "sample_id", signal: str = "signal", seed: int = 0) -> DataFrame:
    """count copies of each recording, changed by the methods in order; the seed of a copy is the hash of its key and number."""
    copies = recordings.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("_seed", F.xxhash64(F.lit(seed), F.col(key), F.col("copy")))
    names = [c for c in copies.columns if c != "_seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, s in zip(batch.column(signal), batch.column("_seed").to_pylist(), strict=True):
                y = np.asarray(x.values, np.float64)
                rng = np.random.default_rng(s & (1 << 63) - 1)
                for m in methods if len(y) > 20 else []:
                    y = AUGMENTATIONS[m](y, rng)
                out.append(y)
            columns = [pa.array(out, pa.list_(pa.float64())) if c == signal else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    wide = copies.withColumn(signal, F.col(signal).cast("array<double>"))
    return wide.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema if f.name != "_seed"))


def demo_recordings(spark, count: int = 8, rate: int = 8000, seconds: float = 2.0) -> DataFrame:
    """Tones with clicks of a known period, made by Spark expressions."""
    t = F.sequence(F.lit(0), F.lit(int(rate * seconds) - 1))
    f = 50.0 + 25.0 * F.col("id")
    signal = F.transform(t, lambda i: F.sin(2 * np.pi * f * i / rate) * 0.2 + F.when(i % (rate // 4) == 0, F.col("id") * 0.5).otherwise(0.0))
    return spark.range(count).select(F.concat(F.lit("demo"), F.col("id"), F.lit("_up")).alias("sample_id"), F.lit(float(rate)).alias("sampling_rate"), signal.alias("signal"))
