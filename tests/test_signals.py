"""Spectra, quality with a rate, heartbeats, features, events and forecasts against NumPy and what theory says."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import core
from undula.core import from_arrays
from undula.functions import special
from undula.functions.signal import hann
from undula.operators import augment, ecg, events, features, filtering, forecast, quality, spectral, statistics

FS = 250.0


def recordings(spark, **values):
    return from_arrays(spark.createDataFrame([(k, [float(v) for v in x]) for k, x in values.items()], "rec string, values array<double>"), "rec", "values")


def heart(seconds=60, rate=72.0, seed=0):
    """Beats with small waves before and after, on a slow drift, and where they are."""
    draw = np.random.default_rng(seed)
    t = np.arange(int(seconds * FS)) / FS
    at = np.cumsum(60 / rate * (1 + 0.05 * draw.standard_normal(int(seconds * rate / 60) + 2)))
    at = at[(at > 0.5) & (at < seconds - 0.5)]
    x = 0.1 * np.sin(2 * np.pi * 0.2 * t) + 0.01 * draw.standard_normal(len(t))
    for b in at:
        for shift, height, width in ((-0.17, 0.12, 0.025), (-0.026, -0.12, 0.01), (0.0, 1.0, 0.011), (0.03, -0.2, 0.01), (0.27, 0.3, 0.06)):
            x += height * np.exp(-0.5 * ((t - b - shift) / width) ** 2)
    return x, np.round(at * FS).astype(int)


@pytest.fixture(scope="module")
def hearts(spark):
    made = {f"h{i}": heart(40, 60 + 25 * i, i) for i in range(3)}
    s = recordings(spark, **{k: x * (-1 if k == "h1" else 1) for k, (x, _) in made.items()}).cache()
    known = spark.createDataFrame([(k, int(b)) for k, (_, at) in made.items() for b in at], "rec string, idx long").cache()
    return s, known, made


def test_beats_are_found(spark, hearts, monkeypatch):
    s, known, _ = hearts
    found = ecg.pan_tompkins(s, FS).cache()
    rows = ecg.match_beats(known, found, FS).collect()
    assert len(rows) == 3 and all(r.f1 > 0.99 for r in rows)
    monkeypatch.setattr(ecg, "SEGMENT", 15)
    monkeypatch.setattr(ecg, "LEAD", 8)
    assert all(r.f1 > 0.98 for r in ecg.match_beats(known, ecg.pan_tompkins(s, FS), FS).collect())
    upright = ecg.detect_r_peaks(s.where("rec <> 'h1'"), FS, "simple")
    assert all(r.f1 > 0.99 for r in ecg.match_beats(known.where("rec <> 'h1'"), upright, FS).collect())


def test_samples_are_dealt_out_once_for_beats(spark, hearts, monkeypatch):
    """Only peaks are written, not samples; beats are the same over small chunks and rows in any order."""
    kept, written = [], ecg.stored
    monkeypatch.setattr(ecg, "stored", lambda df: kept.append(written(df)) or kept[-1])
    x = hearts[0]
    whole = {(r.rec, r.idx) for r in ecg.pan_tompkins(x, FS).collect()}
    assert whole and sum(k.count() for k in kept) < x.count() / 3
    monkeypatch.setattr(ecg.core, "CHUNK", 1000)
    assert {(r.rec, r.idx) for r in ecg.pan_tompkins(x.repartition(5), FS).collect()} == whole


def test_beats_in_written_rows_need_no_samples_dealt_out(spark, hearts, monkeypatch):
    """Both ways to find beats read the same rows, and find the same as in samples, in recordings of one chunk and of more."""
    s, _, made = hearts
    x, draw = made["h0"][0][:3000], np.random.default_rng(8)
    stairs, gap = np.repeat(np.round(draw.normal(size=300)), 10), x.copy()
    gap[100] = np.nan
    s = s.unionByName(recordings(spark, stairs=stairs, gap=gap, noise=draw.normal(size=1490), brief=x[:300], briefer=x[:2], one=[1.0], late=[0.0, 1.0, 1.0, 1.0])).cache()
    for chunk in (core.CHUNK, 1500):
        monkeypatch.setattr(core, "CHUNK", chunk)
        rows = filtering.written_rows(s.repartition(3))
        assert rows.selectExpr("sum(size(values))").first()[0] == s.count()
        for method, more in (("pantompkins", {}), ("simple", {}), ("simple", {"height": 0.1}), ("simple", {"distance": 3})):
            found, want = (ecg.detect_r_peaks(d, FS, method, **more) for d in (rows, s))
            assert chunk == 1500 or "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert (got := sorted(map(tuple, found.collect()))) == sorted(map(tuple, want.collect())) and len(got) > 100
            if method == "simple" and not more:
                monkeypatch.setattr(ecg, "SEGMENT", 15)
                monkeypatch.setattr(ecg, "LEAD", 8)
                found, want = (ecg.detect_r_peaks(d, FS, method) for d in (rows, s))
                assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
                monkeypatch.undo()
                monkeypatch.setattr(core, "CHUNK", chunk)


def test_beats_are_matched_one_to_one(spark):
    known = spark.createDataFrame([("a", 100), ("a", 120), ("a", 900), ("b", 50)], "rec string, idx long")
    found = spark.createDataFrame([("a", 110), ("a", 905), ("a", 895), ("c", 3)], "rec string, idx long")
    got = {r.rec: r for r in ecg.match_beats(known, found, 100.0).collect()}
    assert (got["a"].tp, got["a"].fn, got["a"].fp) == (2, 1, 1) and got["a"].se == pytest.approx(2 / 3)
    assert (got["b"].se, got["b"].ppv, got["b"].f1) == (0.0, 0.0, 0.0) and got["c"].se is None and got["c"].ppv == 0


def test_variability(spark):
    draw = np.random.default_rng(3)
    t, rr = 0.0, []
    for _ in range(300):
        rr.append(850 + 40 * math.sin(2 * math.pi * 0.25 * t) + 20 * math.sin(2 * math.pi * 0.1 * t) + draw.normal(0, 3))
        t += rr[-1] / 1000
    got = {r.rec: r for r in features.hrv(recordings(spark, x=rr, few=rr[:10], two=rr[:2])).collect()}
    x = np.array(rr)
    d = np.diff(x)
    assert got["x"].hrv_beats == 301 and got["x"].hrv_artifact_pct == 0
    assert got["x"].hrv_sdnn_ms == pytest.approx(x.std(ddof=1)) and got["x"].hrv_rmssd_ms == pytest.approx(np.sqrt(np.mean(d * d))) and got["x"].hrv_pnn50_pct == pytest.approx(100 * np.mean(np.abs(d) > 50))
    counts, _ = np.histogram(x, np.arange(x.min(), x.max() + 7.8125, 7.8125))
    assert got["x"].hrv_tri_index == pytest.approx(len(x) / counts.max())
    at = np.cumsum(x) / 1000
    even = np.interp(np.arange(at[0], at[-1], 0.25), at, x)
    n, w, p = 256, hann(256), []
    for a in range(0, len(even) - n + 1, n // 2):
        seg = even[a : a + n] - even[a : a + n].mean()
        p.append(np.abs(np.fft.rfft(seg * w)) ** 2 / (4 * (w * w).sum()) * np.r_[1, np.full(n // 2 - 1, 2), 1])
    f, p = np.arange(n // 2 + 1) * 4 / n, np.mean(p, 0)
    low, high = (f >= 0.04) & (f < 0.15), (f >= 0.15) & (f < 0.4)
    assert got["x"].hrv_lf_power == pytest.approx(np.trapezoid(p[low], f[low]), rel=1e-6) and got["x"].hrv_hf_power == pytest.approx(np.trapezoid(p[high], f[high]), rel=1e-6)
    assert got["few"].hrv_sdnn_ms is not None and got["few"].hrv_lf_power is None and got["two"].hrv_sdnn_ms is None and got["two"].hrv_beats == 3


@pytest.fixture(scope="module")
def defects(spark):
    draw = np.random.default_rng(1)
    t = np.arange(5000) / FS
    clean = np.sin(2 * np.pi * 6 * t) + 0.3 * draw.standard_normal(5000)
    return {
        "clean": clean, "drift": clean + 3 * np.sin(2 * np.pi * 0.2 * t), "hum": clean + 0.8 * np.sin(2 * np.pi * 50 * t), "loud_hum": 0.01 * draw.standard_normal(5000) + 5 * np.sin(2 * np.pi * 60 * t),
        "noise": draw.standard_normal(5000) * np.r_[[1.0] * 5000] + 2 * np.cos(np.pi * np.arange(5000)) * draw.standard_normal(5000),
    }


def test_spectral_defects(spark, defects):
    s = recordings(spark, **defects)
    report = quality.fixes(quality.diagnose(s, FS)).cache()
    got = {r.rec: r for r in report.collect()}
    assert got["clean"].issues == "" and got["clean"].fixes == []
    assert got["drift"].issues == "drift:warning" and [f.step for f in got["drift"].fixes] == ["highpass"]
    assert got["hum"].issues.startswith("mains:") and got["hum"].mains_hz == 50 and [f.step for f in got["hum"].fixes] == ["notch"]
    assert got["loud_hum"].issues.startswith("mains:info") and got["loud_hum"].fixes == []
    cleaned, before, after = quality.auto_clean(s, FS)
    score = {r.rec: r.score for r in after.collect()}
    assert all(score[k] >= got[k].score for k in got) and score["drift"] > got["drift"].score and score["hum"] > got["hum"].score
    assert cleaned.count() == s.count() and before.count() == 5
    assert "drift" not in {r.rec: r.issues for r in quality.diagnose(s, FS, drift_cutoff=None).collect()}["drift"]


def test_timeline_tells_where(spark, defects):
    x = defects["clean"].copy()
    x[2500:3000:50] += 60
    rows = quality.timeline(recordings(spark, a=x), 2.0, None, FS).orderBy("t_start").collect()
    assert [r.t_start for r in rows] == [2.0 * k for k in range(10)]
    assert [k for k, r in enumerate(rows) if "spikes" in r.issues] == [5] and rows[0].ok


def test_heartbeat_checks(spark, hearts):
    s, _, made = hearts
    draw = np.random.default_rng(4)
    flat = recordings(spark, nothing=0.01 * draw.standard_normal(5000), noisy=made["h0"][0][:5000] + 0.8 * draw.standard_normal(5000))
    got = {r.rec: r.issues for r in quality.diagnose(s.unionByName(flat), FS, signal_type="ecg").collect()}
    assert all("ecg" not in got[k] for k in ("h0", "h1", "h2"))
    assert "ecg" in got["noisy"] and "ecg" in got["nothing"]


def test_heartbeat_checks_write_samples_once(spark, hearts, monkeypatch):
    """A recording is written as one row, and what a pass over those rows tells is what the plan over chunks does."""
    s, _, made = hearts
    x, draw = made["h0"][0][:6000], np.random.default_rng(6)
    odd = {k: x.copy() for k in ("gaps", "spiky", "clipped", "flat", "level", "drift")}
    odd["gaps"][[0, 1, *range(700, 760), 2999, 5999]] = np.nan
    odd["spiky"][100::531] += 50
    odd["clipped"] = np.clip(odd["clipped"], -0.05, 0.6)
    odd["flat"][2000:2200] = 0.25
    odd["level"] += 7
    odd["drift"] += 5 * np.sin(np.arange(6000) / 900)
    hum = x + 0.3 * np.sin(2 * np.pi * 50 * np.arange(6000) / FS) + 0.2 * np.sin(2 * np.pi * 100 * np.arange(6000) / FS)
    more = recordings(spark, **odd, hum=hum, noise=draw.standard_normal(5000), digital=np.sign(x), constant=np.ones(3000), empty=np.full(2000, np.nan), brief=x[:400], briefer=x[:200], few=x[:20], one=[1.0])
    s = s.unionByName(more)
    kept, written = [], quality.stored
    with monkeypatch.context() as m:
        for module in (quality, filtering):
            m.setattr(module, "stored", lambda df: kept.append(written(df)) or kept[-1])
        rows = quality.diagnose(s, FS, signal_type="ecg").collect()
    assert sum(k.count() for k in kept) == len(rows) == 18
    monkeypatch.setattr(core, "CHUNK", 1500)
    want = {r.rec: r.asDict() for r in quality.diagnose(s.repartition(3), FS, signal_type="ecg").collect()}
    for r in rows:
        assert {k: v if v is None or isinstance(v, str) else pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want[r.rec].items()} == r.asDict()
    runs = s.groupBy("rec", F.floor(F.col("idx") / 777).alias("c")).agg(F.min("idx").alias("first"), F.array_sort(F.collect_list(F.struct("idx", F.coalesce("value", F.lit(math.nan)).alias("v")))).alias("p"))
    runs = runs.select("rec", "first", F.col("p.v").alias("values"))
    assert sorted(map(str, quality.diagnose(runs, FS, signal_type="ecg").collect())) == sorted(map(str, quality.diagnose(s, FS, signal_type="ecg").collect()))


def test_stft_boundaries(spark):
    x = np.random.default_rng(2).normal(size=100)
    rows = spectral.stft(recordings(spark, a=x), 10.0, 32).collect()
    wide = np.pad(x, 16)
    wide = np.pad(wide, (0, -(len(wide) - 32) % 16))
    want = np.stack([np.fft.rfft(wide[a : a + 32] * hann(32)) / hann(32).sum() for a in range(0, len(wide) - 31, 16)])
    got = np.zeros(want.shape, complex)
    for r in rows:
        got[r.w, r.bin] = complex(r.re, r.im)
        assert r.t == pytest.approx(r.w * 16 / 10)
    assert len(rows) == want.size and np.allclose(got, want)


@pytest.mark.parametrize("name", ["cmor1.5-1.0", "mexh", "gaus1"])
def test_wavelets_peak_at_a_tone(spark, name):
    t = np.arange(1500) / 100
    rows = spectral.wavelet(recordings(spark, a=np.sin(2 * np.pi * 5 * t)), [2.0, 3.5, 5.0, 8.0, 12.0], 100.0, name).where("idx BETWEEN 500 AND 1000").groupBy("freq").agg(F.avg("magnitude").alias("m")).collect()
    size = {r.freq: r.m for r in rows}
    assert max(size, key=size.get) in ((5.0,) if name.startswith("cmor") else (3.5, 5.0))


def test_envelope_coherence_and_lags(spark):
    t = np.arange(2048) / 100
    tone = (1 + 0.3 * np.sin(2 * np.pi * 0.5 * t)) * np.sin(2 * np.pi * 10 * t)
    s = recordings(spark, a=tone)
    env = spectral.hilbert(s, 100.0).where("idx BETWEEN 200 AND 1800").collect()
    assert max(abs(r.envelope - (1 + 0.3 * math.sin(math.pi * r.idx / 100))) for r in env) < 0.02 and np.median([r.frequency for r in env]) == pytest.approx(10, abs=0.1)
    draw = np.random.default_rng(6)
    common = draw.normal(size=4000)
    a, b = recordings(spark, a=common), recordings(spark, a=np.roll(common, 7) + 0.2 * draw.normal(size=4000))
    assert statistics.best_lag(statistics.cross_correlation(b, a, 30)).first().best_lag == 7
    mean = spectral.coherence(a, b, 100.0, 128).agg(F.avg("coherence")).first()[0]
    assert 0.7 < mean <= 1
    x = common[:400] - common[:400].mean()
    got = {r.lag: r.r for r in statistics.autocorrelation(recordings(spark, a=common[:400])).collect()}
    assert sorted(got) == list(range(101)) and all(got[k] == pytest.approx((x[k:] @ x[: 400 - k]) / (x @ x)) for k in (0, 1, 50, 100))


def test_lags_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(statistics, "PIECE", 16)
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=90), draw.normal(size=70)
    got = {r.lag: r.sum for r in statistics.lag_products(recordings(spark, a=x), recordings(spark, a=y), -80, 80).collect()}
    for k in range(-69, 81):
        want = sum(x[i + k] * y[i] for i in range(70) if 0 <= i + k < 90)
        assert got.get(k, 0.0) == pytest.approx(want, abs=1e-9)


def test_inversions_over_runs(spark, monkeypatch):
    monkeypatch.setattr(statistics, "RUN", 8)
    draw = np.random.default_rng(2)
    y = draw.integers(0, 40, 100)
    rows = spark.createDataFrame([("k", i, int(v)) for i, v in enumerate(y)], "key string, px long, py long")
    want = sum(int(y[i] > y[j]) for i in range(100) for j in range(i + 1, 100))
    assert statistics.inversions(rows, ["key"]).first().discordant == want


def test_numbers_over_ranges(spark):
    draw = np.random.default_rng(3)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(draw.integers(0, 3, 300), draw.integers(0, 20, 300), strict=True))]
    got = core.numbered(spark.createDataFrame(rows, "rec long, v double, i long"), ["rec"], ["v", "i"], "place").collect()
    want = {(k, v, i): n for key in range(3) for n, (k, v, i) in enumerate(sorted(r for r in rows if r[0] == key))}
    assert {(r.rec, r.v, r.i): r.place for r in got} == want


def test_resampling(spark):
    t = np.arange(1000) / 100
    s = recordings(spark, a=np.sin(2 * np.pi * 3 * t))
    for target in (250.0, 40.0, 99.0):
        whole = {r.idx: r.value for r in filtering.resample(s, 100.0, target).collect()}
        assert len(whole) == math.ceil(1000 * target / 100)
        assert max(abs(whole[i] - math.sin(2 * math.pi * 3 * i / target)) for i in range(len(whole) // 4, 3 * len(whole) // 4)) < 0.01
        parts = {r.idx: r.value for r in filtering.resample(s, 100.0, target, chunk=64).collect()}
        assert parts.keys() == whole.keys() and all(parts[i] == pytest.approx(whole[i], abs=1e-12) for i in parts)


def test_tails():
    assert special.t_tail(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, abs=1e-8)
    assert special.rank_sum_tail(20, 5, 4) == pytest.approx(2 / 126) and special.kolmogorov_tail(0.274, 10) == pytest.approx(1 - 0.6284796, abs=1e-6)
    assert special.kolmogorov_tail(0.06, 500) == pytest.approx(special.kolmogorov_tail(0.06, 501), abs=0.03)


def test_normality_and_steadiness(spark):
    draw = np.random.default_rng(8)
    s = recordings(spark, normal=draw.normal(size=400), skewed=draw.exponential(size=400), walk=np.cumsum(draw.normal(size=400)))
    ks = {r.rec: r.p for r in statistics.ks_normal(s).collect()}
    k2 = {r.rec: r.p for r in statistics.dagostino(s).collect()}
    assert ks["normal"] > 0.05 > ks["skewed"] and k2["normal"] > 0.05 > k2["skewed"]
    adf = {r.rec: r.stationary for r in statistics.stationarity_adf(s).collect()}
    kpss = {r.rec: r.p for r in statistics.stationarity_kpss(s).collect()}
    assert adf["normal"] and not adf["walk"] and kpss["normal"] >= 0.05 > kpss["walk"]


def brute_cuts(x, least, penalty):
    n, floor = len(x), 1e-6 * np.var(x)
    price = lambda a, b: (b - a) * (np.log(2 * np.pi * max(np.var(x[a:b]), floor)) + 1)
    best, back = [-penalty] + [np.inf] * n, [0] * (n + 1)
    for end in range(least, n + 1):
        for start in range(0, end - least + 1):
            if (c := best[start] + price(start, end) + penalty) < best[end]:
                best[end], back[end] = c, start
    cuts, end = [], n
    while end:
        end = back[end]
        cuts.append(end)
    return sorted(c for c in cuts if c)


def test_change_points(spark):
    draw = np.random.default_rng(9)
    x = np.r_[draw.normal(0, 1, 60), draw.normal(5, 1, 50), draw.normal(5, 4, 70)]
    s = recordings(spark, a=x)
    got = sorted(r.idx for r in events.change_points(s, least=5).collect())
    assert got == brute_cuts(x, 5, 3 * np.log(len(x))) and len(got) >= 2
    parts = events.segments_between(s, events.change_points(s, "mean", least=5)).orderBy("start_s").collect()
    assert sum(r.n for r in parts) == len(x) and parts[0].mean == pytest.approx(x[: parts[0].n].mean())
    long = recordings(spark, b=np.repeat(x, 20))
    assert {r.idx % 36 for r in events.change_points(long, blocks=100).collect()} == {0}


def test_an_odd_window_scores_highest(spark):
    x = np.sin(np.arange(4000) / 5) + 0.05 * np.random.default_rng(1).normal(size=4000)
    x[2000:2100] += 3 * np.random.default_rng(2).normal(size=100)
    rows = events.anomaly_scores(recordings(spark, a=x), 100.0).collect()
    best = max(rows, key=lambda r: r.score)
    assert len(rows) == 40 and best.t_start == 2000 and best.anomaly and all(0 < r.score < 1 for r in rows)


def test_cuts_between_neighbouring_numbers():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    for seed in range(20):  # a draw between the two is rounded to either
        nodes = events._tree(x, np.random.default_rng(seed), 8)
        assert [n[0] for n in nodes] == [0, -1, -1] and nodes[0][1] == 1.0


def test_few_windows_are_scored_without_a_forest_of_nodes():
    """The same scores as by walking down the nodes of _tree()'s trees, in far less time."""
    draw, took = np.random.default_rng(5), [0.0, 0.0]
    ties = np.round(draw.normal(size=(12, 4)))
    ties[3], ties[:, 0] = ties[5], 7
    for x in (draw.normal(size=(16, 14)), ties, np.ones((8, 3)), draw.normal(size=(40, 3))):
        began = time.perf_counter()
        got = events._scores(x, 1)
        took[0] -= began - time.perf_counter()
        began = time.perf_counter()
        rng, total = np.random.default_rng(1), np.zeros(len(x))
        for _ in range(events.TREES):
            nodes = events._tree(x[rng.choice(len(x), len(x), replace=False)], rng, int(np.ceil(np.log2(len(x)))))
            for i, row in enumerate(x):
                c, at, left, right, depth = nodes[0]
                while c >= 0:
                    c, at, left, right, depth = nodes[left if row[c] <= at else right]
                total[i] += depth
        took[1] -= began - time.perf_counter()
        assert (got == 2 ** (-total / events.TREES / events._average_depth(np.array(len(x))))).all()
    assert took[0] < took[1] / 2


def test_every_window_is_scored_whatever_the_recordings_length(spark, monkeypatch):
    monkeypatch.setattr(events, "SEEN", 15)
    x = np.sin(np.arange(300) / 5) + 0.05 * np.random.default_rng(1).normal(size=300)
    x[70:80] += 3 * np.random.default_rng(2).normal(size=10)
    rows = events.anomaly_scores(recordings(spark, few=x[:100], many=x, none=x[:70]), 10.0).collect()
    assert sorted((r.rec, r.t_start) for r in rows) == sorted((k, 10.0 * i) for k, n in (("few", 10), ("many", 30)) for i in range(n))
    best = {k: max((r for r in rows if r.rec == k), key=lambda r: r.score) for k in ("few", "many")}
    assert all(r.t_start == 70 and r.anomaly for r in best.values()) and all(0 < r.score < 1 for r in rows)


def test_features_of_windows_and_recordings(spark):
    t = np.arange(2000) / 100
    x = np.sin(2 * np.pi * 5 * t)
    s = recordings(spark, a=x, b=np.r_[[np.nan], x[1:]])
    got = {r.rec: r for r in features.extract(s, 100.0).collect()}
    assert got["a"].fd_dominant_frequency == pytest.approx(5.0, abs=0.5) and got["a"].pk_count == 100 and got["a"].pk_rate_hz == pytest.approx(5) and got["a"].pk_mean_prominence == pytest.approx(2, rel=0.03)
    assert got["a"].pk_mean_width == pytest.approx(0.1, rel=0.1) and got["a"].nl_higuchi_fd is not None and got["b"].td_mean is None
    rows = features.windowed_features(s.where("rec = 'a'"), 4.0, 2.0, 100.0, ("time", "freq")).orderBy("t_start").collect()
    assert [r.t_start for r in rows] == [2.0 * k for k in range(9)] and all(r.fd_dominant_frequency == pytest.approx(5, abs=0.5) for r in rows)
    with pytest.raises(ValueError, match="unknown"):
        features.extract(s, 100.0, ("time", "colour"))


def test_forecasts(spark):
    t = np.arange(400)
    x = 10 + np.sin(2 * np.pi * t / 20) + 0.05 * np.random.default_rng(5).normal(size=400)
    s = recordings(spark, a=x, b=0.5 * t)
    f = forecast.forecast(s, 15, holdout=True).cache()
    m = {r.rec: r for r in forecast.metrics(f, s).collect()}
    assert m["a"].skill > 0.5 and m["b"].mae < 0.1 and 0 <= m["a"].coverage <= 1
    rows = f.where("rec = 'a'").orderBy("step").collect()
    assert [r.time for r in rows] == [float(k) for k in range(385, 400)] and all(r.lower < r.forecast < r.upper for r in rows)
    seasonal = forecast.forecast(s, 20, order=(1, 0, 0), season=20, holdout=True)
    assert {r.rec: r.mae for r in forecast.metrics(seasonal, s).collect()}["a"] < 0.15


def test_variations_are_the_same_each_time(spark):
    t = np.arange(500) / 100
    s = recordings(spark, a=np.sin(2 * np.pi * 2 * t), b=np.cos(2 * np.pi * 3 * t))
    a = augment.Augmenter(100.0, powerline=1, wander=1, spikes=1, dropout=1, max_shift=0.2, stretch_range=(0.8, 1.2), invert=0.5, seed=3)
    one, two = ({(r.rec, r.copy, r.idx): r.value for r in a.expand(x, 2).collect()} for x in (s, s.repartition(7)))
    assert len(one) == 3 * 1000 and one == pytest.approx(two, abs=1e-9)
    noisy = augment.add_noise(s, 10.0).withColumnRenamed("value", "v").join(s, ["rec", "idx"]).groupBy("rec").agg(F.avg(F.col("value") ** 2).alias("p"), F.avg((F.col("v") - F.col("value")) ** 2).alias("q")).collect()
    assert all(10 * math.log10(r.p / r.q) == pytest.approx(10, abs=1) for r in noisy)
    shifted = {r.idx: r.value for r in augment.time_shift(s.where("rec = 'a'"), 10).collect()}
    assert np.allclose([shifted[i] for i in range(500)], np.roll(np.sin(2 * np.pi * 2 * t), 10))
    stretched = {r.idx: r.value for r in augment.time_stretch(s.where("rec = 'a'"), 1.3).collect()}
    assert np.allclose([stretched[i] for i in range(500)], np.interp(np.clip(np.arange(500) * 1.3, 0, 499), np.arange(500), np.sin(2 * np.pi * 2 * t)))


def test_runs_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 7)
    x = np.random.default_rng(4).integers(0, 2, 60).tolist()
    x[5:31] = [1] * 26
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "rec string, idx long, value double")
    got = sorted((r.first, r.length, r.value) for r in quality.run_lengths(rows, "value", ["rec"]).select("first", "length", "value").collect())
    want, start = [], 0
    for i in range(1, 61):
        if i == 60 or x[i] != x[start]:
            want.append((start, i - start, float(x[start])))
            start = i
    assert got == want
