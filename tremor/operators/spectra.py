"""Spectra and envelopes of recordings: averaged spectra over frames that are rows, and numbers made of them in expressions.

A recording's frames are exploded into rows, so a long one is worked on by as many tasks as its rows are dealt to; each
task adds up the spectra of the frames it has, and only these sums meet. What needs a whole recording at once, its
analytic signal, is made where the recording is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dsp as D

#: Bands in Hz of modulation, of spectra, and the target rate of envelopes.
MODULATION = (("shudder", 1.0, 20.0), ("rough", 20.0, 80.0), ("chatter_lo", 80.0, 200.0), ("chatter_hi", 200.0, 300.0))
BANDS = (("low", 20.0, 200.0), ("mid", 200.0, 1000.0), ("high", 1000.0, 4000.0), ("ultra", 4000.0, 9000.0))
ENVELOPE_RATE = 1000.0
EPS = 1e-12


def frame_size(n: Column) -> Column:
    """Values of a frame: a power of two near a quarter of the recording, 256 to 2048, never more than it has."""
    wanted = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(16), F.floor(n / 4)))))
    return F.least(F.least(F.lit(2048), F.greatest(F.lit(256), wanted)), n).cast("int")


def frames(recordings: DataFrame, key: str, signal: str, size: Column, hop: Column) -> DataFrame:
    """A row for each whole frame: key, rate and the frame's values."""
    n = F.size(signal)
    rows = recordings.select(key, "rate", F.col(signal).alias("_x"), size.alias("_size"), hop.alias("_hop")).where((F.size("_x") >= F.col("_size")) & (F.col("_size") > 0))
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.size("_x") - F.col("_size")) / F.col("_hop")).cast("int")))
    return rows.withColumn("_k", starts).select(key, "rate", F.slice("_x", F.col("_k") * F.col("_hop") + 1, F.col("_size")).alias("frame"))


def _sums(key: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rates, sums, counts = [], [], [], []
            column, ends = batch.column("frame"), batch.column("frame").offsets.to_numpy()
            values, rate = column.values.to_numpy(), batch.column("rate").to_numpy()
            names = batch.column(key)
            same = np.append(False, np.array(names.slice(1).to_pylist(), object) == np.array(names.slice(0, max(len(names) - 1, 0)).to_pylist(), object)) if len(names) > 1 else np.zeros(len(names), bool)
            starts = np.flatnonzero(~same)
            for a, b in zip(starts, np.append(starts[1:], len(names)), strict=True):
                size = ends[a + 1] - ends[a]
                block = values[ends[a] : ends[b]].reshape(-1, size)
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
                power = np.abs(np.fft.rfft((block - block.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (rate[a] * (window**2).sum())
                power[:, 1 : (size + 1) // 2] *= 2
                keys.append(a)
                rates.append((rate[a] / size, rate[a] / 2))
                sums.append(power.sum(0))
                counts.append(b - a)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(keys, pa.int64())), *(pa.array([r[k] for r in rates], pa.float64()) for k in (0, 1)), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.int64())], [key, "step", "highest", "sums", "n"])

    return run, f"`{key}` {kind}, step double, highest double, sums array<double>, n long"


def welch(recordings: DataFrame, key: str, signal: str = "x", size: Column | None = None, overlap: Column | None = None) -> DataFrame:
    """(key, step, highest, psd): the density of each recording's power at multiples of step Hz, and half its rate; recordings of fewer than 16 values have none.

    recordings: key, signal and rate. Frames overlap by half, are freed of their mean and weighed by a periodic Hann window."""
    n = F.size(signal)
    size = frame_size(n) if size is None else size
    wanted = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(16), F.floor(n / 4)))))
    half = F.floor(F.least(F.lit(2048), F.greatest(F.lit(256), wanted)) / 2)
    overlap = F.least(half, F.greatest(F.lit(0), n - 1)) if overlap is None else overlap
    rows = recordings.where(n >= 16).withColumn("rate", F.col("rate").cast("double")).withColumn(signal, F.col(signal).cast("array<double>"))
    run, schema = _sums(key, recordings.schema[key].dataType.simpleString())
    parts = frames(rows, key, signal, size, (size - overlap).cast("int")).mapInArrow(run, schema)
    bins = parts.select(key, "step", "highest", "n", F.posexplode("sums").alias("bin", "s")).groupBy(key, "step", "highest", "bin").agg((F.sum("s") / F.sum("n")).alias("p"))
    return bins.groupBy(key, "step", "highest").agg(F.array_sort(F.collect_list(F.struct("bin", F.greatest("p", F.lit(0.0)).alias("p")))).alias("_b")).select(key, "step", "highest", F.col("_b.p").alias("psd"))


def _trapezoid(psd: Column, step: Column, low: float, high: Column | float) -> Column:
    """The area below a density between two frequencies, the upper one left out."""
    first = F.ceil(F.lit(low) / step - 1e-9).cast("int")
    last = (F.ceil(high / step - 1e-9) - 1).cast("int") if isinstance(high, Column) else (F.ceil(F.lit(high) / step - 1e-9) - 1).cast("int")
    part = F.slice(psd, first + 1, F.greatest(F.least(last, F.size(psd) - 1) - first + 1, F.lit(0)))
    total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(part) > 1, (total - (F.element_at(part, 1) + F.element_at(part, -1)) / 2) * step).otherwise(0.0)


def spectral_shape(spectra: DataFrame) -> DataFrame:
    """spectra with centroid, bandwidth, rolloff, flatness and shares of bands."""
    psd, step = F.col("psd"), F.col("step")
    total = _trapezoid(psd, step, 0.0, F.size(psd) * step) + EPS
    weights = F.transform(psd, lambda v: v + EPS)
    at = F.transform(F.sequence(F.lit(0), F.size(psd) - 1), lambda k: k * step)
    summed = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = spectra.withColumns({"_w": weights, "_f": at, "_total": total}).withColumn("_sum", summed(F.col("_w")))
    rows = rows.withColumn("centroid_hz", summed(F.zip_with("_f", "_w", lambda f, w: f * w)) / F.col("_sum"))
    centre = F.col("centroid_hz")
    bandwidth = F.sqrt(summed(F.zip_with("_f", "_w", lambda f, w: (f - centre) * (f - centre) * w)) / F.col("_sum"))
    limit = 0.85 * summed(psd)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
    rolled = F.aggregate(psd, start, lambda a, v: F.struct((a.s + v).alias("s"), F.when(a.s + v < limit, a.k + 1).otherwise(a.k).alias("k")))
    flat = F.exp(summed(F.transform("_w", F.ln)) / F.size("_w")) / (F.col("_sum") / F.size("_w") + EPS)
    edge = F.least("highest", F.lit(9000.0))
    bands = {name: _trapezoid(psd, step, low, edge if name == "ultra" else high) for name, low, high in BANDS}
    ratios = {f"{name}_ratio": area / (F.col("_total") + EPS) for name, area in bands.items()}
    high_low = (bands["high"] + bands["ultra"]) / (bands["low"] + EPS)
    out = rows.withColumns({"bandwidth_hz": bandwidth, "rolloff85_hz": F.least(rolled["k"], F.size(psd) - 1) * step, "flatness": flat, **ratios, "high_low_ratio": high_low})
    return out.drop("_w", "_f", "_total", "_sum")


def sliding_kurtosis(x: Column, width: int = 256, hop: int = 64) -> Column:
    """struct(max, mean, q95, time_to_max) of the kurtosis of a signal's windows; of the whole signal where it is too short for two."""
    def biased(w: Column) -> Column:
        found = A._let(A.mean(w), lambda mu: A._let(A.central_moment(w, mu, 2), lambda m2: F.when(m2 > 0, A.central_moment(w, mu, 4) / (m2 * m2))))
        return F.when(F.size(w) > 3, found)

    starts = F.sequence(F.lit(1), F.size(x) - width + 1, F.lit(hop))
    values = F.filter(F.transform(starts, lambda s: biased(F.slice(x, s, width))), lambda v: v.isNotNull())
    whole = F.coalesce(biased(x), F.lit(0.0))
    one = lambda a, b, c, d: F.struct(a.alias("max"), b.alias("mean"), c.alias("q95"), d.alias("time_to_max"))
    zero = F.lit(0.0)
    place = lambda k: (F.array_position(k, F.array_max(k)) - 1) / F.greatest(F.size(k) - 1, F.lit(1))
    several = A._let(values, lambda k: F.when(F.size(k) > 0, one(F.array_max(k), A.mean(k), A.quantile(k, 0.95), place(k))).otherwise(one(zero, zero, zero, zero)))
    return F.when(F.size(x) < width + hop, one(whole, whole, whole, zero)).otherwise(several)


def segment_stability(recordings: DataFrame, key: str, signal: str = "x", parts: int = 8) -> DataFrame:
    """(key, rms_cv, rms_max_min_ratio, kurt_cv, high_ratio_cv) over equal parts of each recording, the first ones longer by one value where it does not divide; 0 for short recordings."""
    n = F.size(signal)
    base, more = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    begin = lambda k: k * base + F.least(k, more) + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(F.col(signal), begin(k), base + F.when(k < more, 1).otherwise(0)))
    long = recordings.where(n >= parts * 8).withColumn(signal, F.col(signal).cast("array<double>")).select(key, "rate", F.posexplode(cut).alias("part", "x"))
    named = long.withColumn("id", F.concat_ws(":", F.col(key).cast("string"), F.col("part").cast("string")))
    spectra = welch(named.select("id", "rate", "x"), "id")
    edge = F.least("highest", F.lit(9000.0))
    whole = _trapezoid(F.col("psd"), F.col("step"), 0.0, F.size("psd") * F.col("step"))
    high = spectra.select("id", (_trapezoid(F.col("psd"), F.col("step"), 1000.0, edge) / (whole + 2 * EPS)).alias("high"))
    mu = A.mean(F.col("x"))
    m2 = A.central_moment(F.col("x"), F.col("mu"), 2)
    kurt = F.when((F.size("x") > 3) & (m2 > 0), A.central_moment(F.col("x"), F.col("mu"), 4) / (m2 * m2)).otherwise(0.0)
    rows = named.withColumn("mu", mu).select(key, "id", A.rms(F.col("x")).alias("rms"), kurt.alias("kurt")).join(high, "id", "left").withColumn("high", F.coalesce("high", F.lit(0.0)))
    spread = lambda c, scale: (F.stddev_pop(c) / (scale + EPS)).alias(f"{c}_cv")
    found = rows.groupBy(key).agg(spread("rms", F.avg("rms")), (F.max("rms") / (F.min("rms") + EPS)).alias("rms_max_min_ratio"), spread("kurt", F.avg(F.abs("kurt"))), spread("high", F.avg("high")))
    names = {"rms_cv": "rms_cv", "rms_max_min_ratio": "rms_max_min_ratio", "kurt_cv": "kurt_cv", "high_cv": "high_ratio_cv"}
    return recordings.select(key).join(found, key, "left").select(key, *(F.coalesce(a, F.lit(0.0)).alias(b) for a, b in names.items()))


def envelope_numbers(x: np.ndarray, rate: float) -> dict[str, float]:
    """Of one signal: shares of modulation bands, the envelope's spectrum, its autocorrelation and its pulses; 0 for what a short signal lacks."""
    out = {f"env_mod_{name}": 0.0 for name, _, _ in MODULATION} | dict.fromkeys(("env_chatter_lo", "env_peak_f", "env_kurt", "ac_peak_height", "ac_short_mean", "peak_f_hz", "peak_prominence", "mod_entropy", "pulse_rate", "pulse_iat_cv"), 0.0)
    env, n = D.envelope(x), len(x)
    step = max(1, int(round(rate / ENVELOPE_RATE)))

    def spectrum(values: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
        return np.fft.rfftfreq(len(values), 1 / at), np.abs(np.fft.rfft((values - values.mean()) * np.hanning(len(values))))

    slow = D.decimated(env, step)
    if n >= int(rate) and len(slow) >= 16:
        f, s = spectrum(slow, rate / step)
        total = float((s[f >= 1] ** 2).sum()) + EPS
        out |= {f"env_mod_{name}": float((s[(f >= low) & (f < high)] ** 2).sum() / total) for name, low, high in MODULATION}
    slow, at = (slow, rate / step) if step > 1 and n > step * 16 else (env, rate)
    if n >= 64 and len(slow) >= 32:
        f, s = spectrum(slow, at)
        total = float((s[f >= 1] ** 2).sum()) + EPS
        out |= {"env_chatter_lo": float((s[(f >= 80) & (f < 200)] ** 2).sum() / total), "env_peak_f": float(f[f >= 1][s[f >= 1].argmax()]) if (f >= 1).any() else 0.0, "env_kurt": D.biased_kurtosis(env)}
    most = min(max(15, int(rate * 0.05)), n // 4)
    if n >= 200 and most >= 15:
        level = np.abs(x) - np.abs(x).mean()
        spread = np.fft.rfft(level, 2 * n)
        lags = np.fft.irfft(spread * spread.conj(), 2 * n)[: most + 1] / (float(level @ level) + EPS)
        out |= {"ac_peak_height": float(lags[5:].max()), "ac_short_mean": float(lags[1:11].mean())}
    if n >= 16:
        level = env - env.mean()
        f, p = np.fft.rfftfreq(n, 1 / rate), np.abs(np.fft.rfft(level)) ** 2
        inside = (f >= 1) & (f <= min(300.0, rate / 2))
        if inside.any():
            f, p = f[inside], p[inside]
            share = p / p.sum() if p.sum() > 0 else p
            out |= {"peak_f_hz": float(f[p.argmax()]), "peak_prominence": float(p.max() / (np.median(p) + EPS)), "mod_entropy": float(-(share * np.log2(share + EPS)).sum() / np.log2(max(2, len(p)))) if p.sum() > 0 else 0.0}
        width = max(3, int(round(rate * 0.002)))
        even = D.smoothed(level, width + 1 - width % 2)
        place, _ = D.peaks(even, 0.0, max(1, int(round(rate * 0.002))))
        place = place[even[place] >= even.mean() + 2.5 * even.std()]
        gaps = np.diff(place) / rate
        out |= {"pulse_rate": len(place) / max(n / rate, EPS), "pulse_iat_cv": float(gaps.std() / (gaps.mean() + EPS)) if len(place) >= 3 else 0.0}
    return out


NUMBERS = tuple(envelope_numbers(np.zeros(4), 8.0))


def with_envelopes(recordings: DataFrame, signal: str = "x", rate: str = "rate") -> DataFrame:
    """recordings with the numbers of their envelopes, null for recordings without values."""

    @F.pandas_udf(", ".join(f"{n} double" for n in NUMBERS))
    def numbers(xs: pd.Series, rates: pd.Series) -> pd.DataFrame:
        found = [envelope_numbers(np.asarray(x, float), float(r)) if x is not None and len(x) else dict.fromkeys(NUMBERS) for x, r in zip(xs, rates, strict=True)]
        return pd.DataFrame(found, columns=NUMBERS, dtype=float)

    found = recordings.withColumn("_e", numbers(F.col(signal).cast("array<double>"), F.col(rate).cast("double")))
    return found.select(*recordings.columns, "_e.*")


def relative_shocks(rows: DataFrame) -> DataFrame:
    """rows with ratios of numbers that they have: of bands to all of them and to their range, and of two mel scales; 0 for no number to divide by."""
    def value(name: str) -> Column:
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) if name in rows.columns else F.lit(0.0)

    def ratio(a: str, b: str) -> Column:
        return F.when(F.abs(value(b)) > EPS, value(a) / value(b)).otherwise(0.0)

    out: dict[str, Column] = {}
    for scale in ("mel", "mel13"):
        for band in ("low", "med", "high"):
            key, own, every = f"v6_rel_{scale}_{band}", f"{scale}_shock_{band}", f"{scale}_shock_all"
            out |= {f"{key}_count_to_all": ratio(f"{own}_count_per_sec", f"{every}_count_per_sec"), f"{key}_kurt_to_all": ratio(f"{own}_kurtosis_q95", f"{every}_kurtosis_q95")}
            out |= {f"{key}_response_to_all": ratio(f"{own}_response_db_q95", f"{every}_response_db_q95"), f"{key}_response_to_dynamic_range": ratio(f"{own}_response_db_q95", f"{scale}_loud_{band}_dynamic_range_db")}
        out[f"v6_rel_{scale}_high_to_low_count"] = ratio(f"{scale}_shock_high_count_per_sec", f"{scale}_shock_low_count_per_sec")
    for band in ("low", "med", "high", "all"):
        for metric in ("count_per_sec", "kurtosis_q95", "response_db_q95", "interval_cv"):
            out[f"v6_rel_{band}_{metric}_mel13_to_mel26"] = ratio(f"mel13_shock_{band}_{metric}", f"mel_shock_{band}_{metric}")
    return rows.withColumns(out)
