import numpy as np
import pytest

from tremor.functions import dsp as D
from tremor.operators import features as X
from tremor.plans import signal_queries as Q

RATE = 8000.0
T = np.arange(16000) / RATE


def test_filters_keep_and_remove_tones():
    low, high = np.sin(2 * np.pi * 50 * T), np.sin(2 * np.pi * 1000 * T)
    assert np.abs(D.zero_phase(low + high, RATE, low=400.0) - high)[800:-800].max() < 0.01
    assert np.abs(D.zero_phase(low + high, RATE, high=200.0) - low)[800:-800].max() < 0.01
    half = D.zero_phase(high, RATE, low=1000.0)[800:-800]
    assert np.abs(half).max() == pytest.approx(0.5, abs=0.01)


def test_stft_and_envelope_of_a_tone():
    tone = 0.5 * np.sin(2 * np.pi * 1000 * T)
    power = D.stft_power(tone)
    assert power.shape[0] == 129 and power.mean(1).argmax() == 32
    assert power.mean(1)[32] == pytest.approx(0.25**2, rel=1e-3)
    assert D.envelope(tone) == pytest.approx(np.full(len(tone), 0.5), abs=1e-6)


def test_wavelet_bands_and_peaks():
    assert np.abs(D.wavelet(np.ones(512))[-1]).max() < 1e-9
    assert (D.DB4**2).sum() == pytest.approx(1) and D.DB4.sum() == pytest.approx(np.sqrt(2))
    x = np.zeros(100)
    x[[10, 30, 32, 70]] = [1, 5, 3, 2]
    place, height = D.peaks(x, 1.5, 5)
    assert place.tolist() == [30, 70] and height.tolist() == [5, 2]


def test_small_kernels():
    assert D.longest_true(np.array([1, 1, 0, 1, 1, 1, 0], bool)) == 3
    assert D.frames(np.arange(10), 4, 3).tolist() == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert D.frames(np.arange(11), 4, 3)[-1].tolist() == [7, 8, 9, 10]
    assert D.kurtosis(np.random.default_rng(0).normal(size=200000)) == pytest.approx(3, abs=0.05)
    assert D.robust_scale(np.random.default_rng(0).normal(size=200000)) == pytest.approx(1, abs=0.01)


def test_every_feature_is_finite():
    for x in (np.random.default_rng(1).normal(size=24000), np.zeros(9000), np.ones(300), np.sin(2 * np.pi * 50 * T)):
        found = X.extract_full(x, RATE)
        assert len(found) == 195 and all(np.isfinite(v) for v in found.values())


def test_extraction_and_augmentation_in_spark(spark):
    rows = X.demo_recordings(spark)
    out = X.with_features(rows).orderBy("sample_id").collect()
    assert len(out) == 8 and all(r.error is None for r in out)
    assert out[-1].kurtosis > out[0].kurtosis and out[0].duration == 2.0
    bad = X.with_features(rows.limit(1).withColumn("signal", rows["signal"].cast("array<double>")).selectExpr("sample_id", "sampling_rate", "cast(null AS array<double>) AS signal")).first()
    assert bad.error and bad.mean is None
    first = X.augmented(rows.limit(2), list(X.AUGMENTATIONS), 3).collect()
    again = X.augmented(rows.limit(2), list(X.AUGMENTATIONS), 3).collect()
    assert len(first) == 6 and all(len(r.signal) == 16000 for r in first)
    assert {(r.sample_id, r.copy): r.signal for r in first} == {(r.sample_id, r.copy): r.signal for r in again}


def test_recording_features_reads_all_rows(spark, tmp_path):
    """Signals of the tables in whole, down to one sample and none."""
    vectors = [(i, [float((i + 1) * (k % 7) - k % 3) for k in range(64)]) for i in range(11)] + [(90, [1.5]), (91, []), (92, [0.0] * 64), (93, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = [(i, 1000 - i, i % 5, float(i)) for i in range(100)]
    table = spark.createDataFrame(events, "event_id long, s long, user_id long, value double")
    table.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    signals = {r.sample_id: r.signal for r in Q.recordings(spark, str(tmp_path)).collect()}
    assert signals["user3"] == [float(i) for i in range(98, 0, -5)] and signals["vec90"] == [1.5]
    got = {r.sample_id: r for r in Q.recording_features(spark, str(tmp_path)).collect()}
    assert set(got) == {f"vec{i}" for i, _ in vectors} | {f"user{u}" for u in range(5)}
    assert {k for k, r in got.items() if r.error} == {"vec91"}
    assert all(got[k]["mean"] == np.mean(x) for k, x in signals.items() if x)
