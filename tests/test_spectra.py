"""Spectra and envelopes against plain versions and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import dsp as D
from tremor.operators import spectra as S


def plain_welch(x, rate, size, overlap):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total, n = 0, 0
    for s in range(0, len(x) - size + 1, size - overlap):
        frame = (x[s : s + size] - x[s : s + size].mean()) * window
        total, n = total + np.abs(np.fft.rfft(frame)) ** 2, n + 1
    psd = total / n / (rate * (window**2).sum())
    psd[1 : (size + 1) // 2] *= 2
    return np.arange(len(psd)) * rate / size, psd


def test_welch_of_recordings_of_any_length(spark):
    rng = np.random.default_rng(1)
    signals = {"a": rng.normal(size=5000) + np.sin(np.arange(5000) * 2 * np.pi * 0.1), "b": rng.normal(size=300), "c": rng.normal(size=17), "d": rng.normal(size=9), "e": np.zeros(400)}
    rows = spark.createDataFrame([(k, x.tolist(), 8000.0) for k, x in signals.items()], "key string, x array<double>, rate double")
    out = {r["key"]: r for r in S.spectral_shape(S.welch(rows, "key")).collect()}
    assert set(out) == {"a", "b", "c", "e"}
    for key in "abc":
        x = signals[key]
        wanted = int(min(2048, max(256, 2 ** int(np.floor(np.log2(max(16, len(x) // 4)))))))
        f, psd = plain_welch(x, 8000, min(wanted, len(x)), min(wanted // 2, len(x) - 1))
        got = out[key]
        assert np.allclose(got["psd"], psd) and got["step"] == pytest.approx(f[1])
        w = psd + 1e-12
        centre = (f * w).sum() / w.sum()
        area = lambda lo, hi: float(np.trapezoid(psd[(f >= lo) & (f < hi)], f[(f >= lo) & (f < hi)])) if ((f >= lo) & (f < hi)).any() else 0.0
        total = np.trapezoid(psd, f) + 1e-12
        low, mid, high, ultra = area(20, 200), area(200, 1000), area(1000, 4000), area(4000, min(4000, 9000))
        expected = {"centroid_hz": centre, "bandwidth_hz": math.sqrt(((f - centre) ** 2 * w).sum() / w.sum()), "rolloff85_hz": f[np.searchsorted(np.cumsum(psd), 0.85 * np.cumsum(psd)[-1])], "flatness": math.exp(np.log(w).mean()) / (w.mean() + 1e-12)}
        expected |= {"low_ratio": low / total, "mid_ratio": mid / total, "high_ratio": high / total, "ultra_ratio": ultra / total, "high_low_ratio": (high + ultra) / (low + 1e-12)}
        for name, value in expected.items():
            assert got[name] == pytest.approx(value, rel=1e-6, abs=1e-9), (key, name)
    assert out["e"]["flatness"] == pytest.approx(0.5) and out["e"]["high_ratio"] == 0.0


def test_segments_by_prefix_sums():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(5, 1, 300), np.full(40, 2.0), rng.normal(size=200)])
    starts, ends = np.array([0, 10, 300, 305, 400, 7]), np.array([300, 60, 340, 308, 540, 7])
    got = D.segment_kurtosis(D.prefix_moments(x), starts, ends)
    assert got[[0, 1, 4]] == pytest.approx([D.biased_kurtosis(x[a:b]) for a, b in zip(starts[[0, 1, 4]], ends[[0, 1, 4]], strict=True)])
    assert np.isnan(got[2]) and got[3] == 0 and got[5] == 0
    n, k = 50, D.biased_kurtosis(x[10:60])
    unbiased = D.segment_kurtosis(D.prefix_moments(x), starts[1:2], ends[1:2], biased=False, fisher=True)
    assert unbiased == pytest.approx([((n * n - 1) * k - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3))])


def test_sliding_kurtosis_of_short_and_silent_signals(spark):
    rng = np.random.default_rng(3)
    long = rng.normal(size=1000)
    long[700] = 40
    rows = spark.createDataFrame([("long", long.tolist()), ("short", long[:300].tolist()), ("still", [1.0] * 400), ("none", [])], "key string, x array<double>")
    out = {r["key"]: r["k"] for r in rows.select("key", S.sliding_kurtosis(F.col("x")).alias("k")).collect()}
    values = [D.biased_kurtosis(long[s : s + 256]) for s in range(0, 745, 64)]
    assert (out["long"]["max"], out["long"]["mean"], out["long"]["q95"]) == pytest.approx((max(values), np.mean(values), np.percentile(values, 95)))
    assert out["long"]["time_to_max"] == pytest.approx(np.argmax(values) / (len(values) - 1))
    assert out["short"]["max"] == out["short"]["mean"] == pytest.approx(D.biased_kurtosis(long[:300]))
    assert tuple(out["still"]) == tuple(out["none"]) == (0.0, 0.0, 0.0, 0.0)


def test_stability_of_segments(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2003) * np.linspace(1, 3, 2003)
    rows = spark.createDataFrame([("a", x.tolist(), 8000.0), ("b", [1.0] * 20, 8000.0)], "key string, x array<double>, rate double")
    out = {r["key"]: r for r in S.segment_stability(rows, "key").collect()}
    parts = np.array_split(x, 8)
    rms, kurt, high = np.array([math.sqrt((p * p).mean()) for p in parts]), np.array([D.biased_kurtosis(p) for p in parts]), []
    for p in parts:
        f, psd = plain_welch(p, 8000, min(256, len(p)), min(128, len(p) - 1))
        inside = (f >= 1000) & (f < 4000)
        high.append(np.trapezoid(psd[inside], f[inside]) / np.trapezoid(psd, f))
    assert tuple(out["a"])[1:] == pytest.approx((rms.std() / rms.mean(), rms.max() / rms.min(), kurt.std() / np.abs(kurt).mean(), np.std(high) / np.mean(high)), rel=1e-6)
    assert tuple(out["b"])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_modulated_tone(spark):
    rate, t = 8000, np.arange(16000) / 8000
    x = (1 + 0.8 * np.sin(2 * np.pi * 120 * t)) * np.sin(2 * np.pi * 1500 * t)
    rows = spark.createDataFrame([("a", x.tolist(), float(rate)), ("b", [0.5] * 10, 8000.0), ("c", [], 8000.0), ("d", None, 8000.0)], "key string, x array<double>, rate double")
    out = {r["key"]: r for r in S.with_envelopes(rows).collect()}
    a = out["a"]
    assert a["env_mod_chatter_lo"] > 0.97 and a["env_chatter_lo"] > 0.97 and abs(a["env_peak_f"] - 120) <= 0.5 and abs(a["peak_f_hz"] - 120) <= 0.5
    assert a["ac_peak_height"] > 0.5 and a["mod_entropy"] < 0.2 and a["peak_prominence"] > 1e3
    assert out["b"]["env_kurt"] == 0.0 and out["c"]["env_kurt"] is None and out["d"]["env_kurt"] is None


def test_pulses_at_even_distances():
    rate = 4000
    x = np.zeros(8000)
    x[100::400] = 1.0
    found = S.envelope_numbers(np.convolve(x, np.hanning(9), "same"), rate)
    assert found["pulse_rate"] == pytest.approx(10, abs=0.6) and found["pulse_iat_cv"] < 0.02


def test_smoothing_keeps_parabolas_and_decimation_keeps_slow_waves():
    t = np.arange(50.0)
    assert np.allclose(D.smoothed(3 + t - 0.2 * t**2, 7), 3 + t - 0.2 * t**2)
    noisy = np.random.default_rng(5).normal(size=60)
    fit = [np.polyval(np.polyfit(np.arange(-3, 4), noisy[k - 3 : k + 4], 2), 0) for k in range(3, 57)]
    assert np.allclose(D.smoothed(noisy, 7)[3:-3], fit)
    slow, fast = np.sin(2 * np.pi * 5 * np.arange(8000) / 8000), np.sin(2 * np.pi * 900 * np.arange(8000) / 8000)
    assert np.allclose(D.decimated(slow + fast, 8)[20:-20], slow[::8][20:-20], atol=0.03)


def test_relative_shocks(spark):
    rows = spark.createDataFrame([(2.0, 4.0, 0.0, float("nan"))], "mel_shock_low_count_per_sec double, mel_shock_all_count_per_sec double, mel13_shock_all_count_per_sec double, mel_shock_high_count_per_sec double")
    out = S.relative_shocks(rows).first()
    assert (out["v6_rel_mel_low_count_to_all"], out["v6_rel_mel_high_to_low_count"], out["v6_rel_mel13_low_count_to_all"], out["v6_rel_all_count_per_sec_mel13_to_mel26"]) == (0.5, 0.0, 0.0, 0.0)
    assert len(out) == 4 + 2 * 13 + 16
