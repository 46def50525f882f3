"""Every signal operator on recordings that are short, even, empty of values or full of gaps: no error, and defined values."""

import math

import pytest
from pyspark.sql import functions as F

from undula.operators import augment, cleaning, ecg, events, features, filtering, forecast, normalize, outliers, quality, spectral, statistics
from undula.sources import export

SCHEMA = "rec string, idx long, value double"
RECORDINGS = {
    "one": [3.0], "two": [1.0, 4.0], "three": [2.0, 2.5, 1.0], "constant": [5.0] * 80, "missing": [None] * 40, "gappy": [None if i % 5 < 2 else math.sin(i) for i in range(80)],
    "lone": [None, 7.0, None], "long": [math.sin(0.3 * i) + 0.1 * ((i * 7919) % 13) for i in range(300)],
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(r, i, v) for r, x in RECORDINGS.items() for i, v in enumerate(x)], SCHEMA).cache()


def channels(samples):
    """All recordings but the empty ones as channels of one."""
    return samples.where("rec NOT IN ('missing')")


def groups(samples):
    return samples.withColumnRenamed("rec", "g")


OPERATORS = {
    **{f"fill_{m}": lambda s, m=m: cleaning.fill(s, m) for m in ("interpolate", "ffill", "bfill", "zero", "mean", "median", "drop")},
    "impute_knn": cleaning.impute_knn, "drop_rows": cleaning.drop_rows, "clip": lambda s: cleaning.clip(s, 0, 1), "crop": lambda s: cleaning.crop(s, 1, 3), "remove_dc": cleaning.remove_dc, "winsorize": cleaning.winsorize,
    **{f"outliers_{m}": f for m, f in outliers.DETECTORS.items()}, "rolling_median": lambda s: outliers.rolling_median(s, 5),
    **{f"remove_{f}": lambda s, f=f: outliers.remove_outliers(s, "zscore", f) for f in ("interpolate", "median", "nan")},
    **{f"normalize_{m}": lambda s, m=m: normalize.normalize(s, m) for m in ("minmax", "zscore", "robust", "l2")},
    **{k: lambda s, k=k: filtering.butter(s, k, 1.0 if k[0] in "lh" else (1.0, 2.0), 10.0, 2) for k in ("lowpass", "highpass", "bandpass", "bandstop")},
    "causal": lambda s: filtering.butter(s, "lowpass", 1.0, 10.0, zero_phase=False), "notch": lambda s: filtering.notch_filter(s, 2.0, 10.0), "fir": lambda s: filtering.fir_filter(s, 1.0, 10.0, taps=11),
    "savgol": filtering.savgol, "median_filter": filtering.median_filter, "resample": lambda s: filtering.resample(s, 10.0, 4.0),
    "fft": spectral.fft, "welch": lambda s: spectral.welch(s, 10.0, 32), "coherence": lambda s: spectral.coherence(s, s, 10.0, 32), "stft": lambda s: spectral.stft(s, 10.0, 32), "hilbert": spectral.hilbert,
    "wavelet": lambda s: spectral.wavelet(s, [1.0, 2.0], 10.0),
    "describe": statistics.describe, "simple_measures": statistics.simple_measures, "dagostino": statistics.dagostino, "ks_normal": statistics.ks_normal, "kpss": statistics.stationarity_kpss, "adf": statistics.stationarity_adf,
    "welch_ttest": lambda s: statistics.welch_ttest(groups(s), "g"), "one_sample": lambda s: statistics.one_sample_ttest(s, 1.0), "paired": lambda s: statistics.paired_ttest(s, s),
    "mannwhitney": lambda s: statistics.mannwhitney(groups(s), "g", "constant", "missing"), "mannwhitney_ties": lambda s: statistics.mannwhitney(groups(s).withColumn("value", F.lit(1.0)), "g", "one", "two"),
    "linear_regression": statistics.linear_regression, "detrend": statistics.detrend, "detrend_constant": lambda s: statistics.detrend(s, "constant"), "detrend_quadratic": statistics.detrend_quadratic, "detrend_5": lambda s: statistics.detrend_polynomial(s, 5),
    **{f"correlate_{m}": lambda s, m=m: statistics.correlate(channels(s), m) for m in ("pearson", "spearman", "kendall")},
    "autocorrelation": lambda s: statistics.autocorrelation(s, 8), "autocorrelation_own": statistics.autocorrelation, "cross_correlation": lambda s: statistics.cross_correlation(s, s, 5),
    "diagnose": quality.diagnose, "diagnose_rate": lambda s: quality.fixes(quality.diagnose(s, 100.0, signal_type="ecg")), "screen": quality.screen, "missing_runs": quality.missing_runs, "flat_mask": lambda s: quality.flat_mask(s, 5),
    "timeline": lambda s: quality.timeline(s, 40.0), "auto_clean": lambda s: quality.auto_clean(s, 100.0)[0],
    "time_domain": features.time_domain, "permutation_entropy": features.permutation_entropy, "higuchi_fd": features.higuchi_fd, "dfa_alpha": features.dfa_alpha, "sample_entropy": features.sample_entropy,
    "frequency_domain": lambda s: features.frequency_domain(spectral.welch(s, 10.0)), "hrv_time": features.hrv_time, "hrv": features.hrv, "nonlinear": features.nonlinear, "peaks": lambda s: features.peaks(s, 10.0),
    "extract": lambda s: features.extract(s, 100.0, features.CATEGORIES), "windowed": lambda s: features.windowed_features(s, 2.0, None, 10.0), "windowed_time": lambda s: features.windowed_features(s, 20.0, include=("time", "nonlinear")),
    "pan_tompkins": lambda s: ecg.pan_tompkins(s, 100.0), "simple_r_peaks": lambda s: ecg.simple_r_peaks(s, 10.0), "change_points": events.change_points, "anomaly": lambda s: events.anomaly_scores(s, 8.0),
    "forecast": lambda s: forecast.forecast(s, 3, order=(1, 0, 0)), "stretch": lambda s: augment.time_stretch(s, 1.5), "shift": lambda s: augment.time_shift(s, 3),
    "augment": lambda s: augment.Augmenter(10.0, powerline=1, wander=1, spikes=1, dropout=1, max_shift=0.3, stretch_range=(0.8, 1.2), invert=0.5).expand(s, 2),
    "examples": lambda s: export.examples(s.withColumn("channel", F.lit("x")), 8), "thinned": lambda s: export.thinned(s, 10),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nothing_fails(samples, name):
    rows = OPERATORS[name](samples).collect()
    numbers = [v for r in rows for v in r if isinstance(v, float)]
    assert not any(math.isnan(v) for v in numbers)


@pytest.mark.parametrize("name", ["fill_interpolate", "outliers_spike", "welch", "bandpass", "correlate_kendall", "kpss", "hrv", "diagnose_rate", "peaks", "change_points", "forecast", "augment"])
def test_no_recordings_at_all(samples, name):
    assert OPERATORS[name](samples.where("rec = 'nobody'")).collect() == []


def by_rec(df):
    return {r.rec: r for r in df.collect()}


def test_values_of_short_recordings(samples):
    t = by_rec(statistics.one_sample_ttest(samples, 1.0))
    assert t["one"].t is None and t["constant"].p is None and t["missing"].n == 0 and t["two"].p is not None
    line = by_rec(statistics.linear_regression(samples))
    assert line["one"].slope is None and line["two"].slope == 3.0 and line["two"].stderr is None and line["three"].p is not None
    assert by_rec(statistics.dagostino(samples))["three"].k2 is None
    assert all(abs(r.value) < 1e-9 for r in statistics.detrend_polynomial(samples, 5).where("rec = 'three'").collect())
    assert all(r.r is None and r.p is None for r in statistics.correlate(channels(samples)).where("channel_a = 'constant' OR channel_b = 'constant'").collect())
    assert all(v.value is None for v in filtering.butter(samples, "lowpass", 1.0, 10.0).where("rec = 'two'").collect())
    codes = {r: x.issues for r, x in by_rec(quality.diagnose(samples, 100.0)).items()}
    assert codes["missing"] == "empty:critical" and codes["constant"] == "constant:critical" and codes["one"] == "short:critical" and "missing:critical" in codes["gappy"]


def test_rolling_median_of_what_is_there(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, None, 9.0, 3.0, 4.0, 5.0])], SCHEMA)
    got = {r.idx: r.med for r in outliers.rolling_median(s, 5).collect()}
    assert got == {0: 1.0, 1: 1.5, 2: 2.5, 3: 3.5, 4: 4.5, 5: 5.0, 6: 5.0}


def test_features_that_need_a_rate(samples):
    for f in (lambda s: features.extract(s), lambda s: features.windowed_features(s, 20.0), lambda s: features.windowed_features(s, 20.0, include=("hrv",))):
        with pytest.raises(ValueError, match="need a rate"):
            f(samples)
