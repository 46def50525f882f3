"""Features against NumPy."""

import math
from collections import Counter

import numpy as np
import pytest

from undula import core
from undula.core import from_arrays
from undula.operators import features, statistics


def recordings(spark, **values):
    return from_arrays(spark.createDataFrame([(k, list(map(float, v))) for k, v in values.items()], "rec string, values array<double>"), "rec", "values")


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_missed_and_extra_beats_are_left_out(spark, monkeypatch, chunk):
    monkeypatch.setattr(core, "CHUNK", chunk)
    draw = np.random.default_rng(3)
    clean = draw.normal(850, 30, 60)
    s = recordings(spark, inserted=np.insert(clean, 30, [314, 536]), edge=np.append(clean[:30], 314), few=[800, 1600, 810, 805], five=[800, 810, 1600, 790, 805])
    got = {r.rec: r for r in features.hrv_time(s).collect()}
    assert got["inserted"].hrv_sdnn == pytest.approx(clean.std(ddof=1), rel=1e-9)
    assert got["inserted"].hrv_rmssd == pytest.approx(np.sqrt(np.mean(np.diff(clean) ** 2)), rel=1e-9)
    assert got["inserted"].hrv_artifact_pct == pytest.approx(200 / 62)
    assert got["edge"].hrv_artifact_pct == pytest.approx(100 / 31)
    assert got["few"].hrv_artifact_pct == 0 and got["five"].hrv_artifact_pct == pytest.approx(20)


def test_ratio_of_points_on_a_line(spark):
    """As floating point, and so the SQL, has it: the spread along the line is 0."""
    got = {r.rec: r.hrv_sd_ratio for r in features.hrv_time(recordings(spark, line=[800, 900, 800], even=[800] * 6, both=[800, 900, 810, 790]), rel=None).collect()}
    assert got["line"] == math.inf and math.isnan(got["even"]) and 0 < got["both"] < math.inf


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_values_that_equal_the_mean(spark, monkeypatch, chunk):
    """Which side of the mean they lie on hangs on the order of the sum, which is the values'."""
    monkeypatch.setattr(core, "CHUNK", chunk)
    draw = np.random.default_rng(1)
    series, want = {}, {}
    while len(series) < 8:
        x = np.round(draw.exponential(50, 16), 2)
        x[5] = np.round((x.sum() - x[5]) / 15, 2)
        forth, back = (np.cumsum(v)[-1] / 16 for v in (x, x[::-1]))
        low = x < forth
        if (x[5] < forth) != (x[5] < back):
            series[str(len(series))] = x
            want[str(len(want))] = np.count_nonzero(low[1:] != low[:-1]) / 15
    rows = [(r, i, float(v)) for r, x in series.items() for i, v in reversed(list(enumerate(x)))]
    s = spark.createDataFrame(rows, "rec string, idx long, value double").coalesce(1)
    assert {r.rec: r.zero_crossing_rate for r in statistics.simple_measures(s).collect()} == want
    assert {r.rec: r.td_zero_crossing_rate for r in features.time_domain(s).collect()} == want
    assert {r.rec: r.td_zero_crossing_rate for r in features.windowed_time_domain(s, 16).collect()} == want


def fluctuation_exponent(x):
    n, y = len(x), np.cumsum(x - np.mean(x))
    scales = np.unique(np.floor(8 * (n // 4 / 8) ** (np.arange(12) / 11) + 1e-9).astype(int))
    spread = []
    for size in scales:
        t, segs = np.arange(size), y[: n // size * size].reshape(-1, size).T
        spread.append(np.sqrt(np.mean((segs - np.vander(t, 2) @ np.polyfit(t, segs, 1)) ** 2)))
    return np.polyfit(np.log(scales), np.log(spread), 1)[0]


def test_scales_reach_a_quarter_of_each_recording(spark):
    white = np.random.default_rng(42).normal(size=5000)
    # Steady for 40 samples, white in the long run.
    blocks = np.repeat(np.random.default_rng(5).normal(size=125), 40) + white / 2
    s = recordings(spark, white=white, brown=np.cumsum(white), blocks=blocks, few=white[:31], two=white[:38], three=white[:42], flat=np.full(100, 0.1))
    got = {r.rec: r.dfa_alpha for r in features.dfa_alpha(s).collect()}
    assert got.keys() == {"white", "brown", "blocks", "few", "two", "three", "flat"}
    assert got["few"] is None and got["two"] is None and got["flat"] is None
    assert got["white"] == pytest.approx(0.5, abs=0.15) and got["brown"] == pytest.approx(1.5, abs=0.15)
    for name, x in (("white", white), ("brown", np.cumsum(white)), ("blocks", blocks), ("three", white[:42])):
        assert got[name] == pytest.approx(fluctuation_exponent(x), rel=1e-6)
    short = {r.rec: r.dfa_alpha for r in features.dfa_alpha(s, [4, 6, 8, 12, 16]).collect()}
    assert abs(got["white"] - 0.5) < 0.02 < abs(short["white"] - 0.5)


def test_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(core, "CHUNK", 7)
    x = np.random.default_rng(8).normal(size=40)
    rows = features.summed_up(recordings(spark, a=x, b=2 * x), "value").orderBy("rec", "idx").collect()
    assert [r.value for r in rows] == pytest.approx([*np.cumsum(x), *np.cumsum(2 * x)])


@pytest.mark.parametrize(("order", "delay"), [(2, 1), (3, 1), (3, 4), (4, 2), (5, 1)])
def test_permutation_entropy_of_any_order(spark, order, delay):
    x = np.random.default_rng(order * 10 + delay).integers(0, 6, 200).astype(float)  # with ties
    got = features.permutation_entropy(recordings(spark, a=x, short=[1.0]), order, delay).collect()
    seen = Counter(tuple(np.argsort(x[i : i + (order - 1) * delay + 1 : delay], kind="stable")) for i in range(200 - (order - 1) * delay))
    p = np.array(list(seen.values())) / sum(seen.values())
    assert [r.rec for r in got] == ["a"] and got[0].perm_entropy == pytest.approx(-(p @ np.log(p)) / np.log(float(np.prod(range(1, order + 1)))))
    for bad in ((1, 1), (3, 0)):
        with pytest.raises(ValueError):
            features.permutation_entropy(recordings(spark, a=x), *bad)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_fluctuations_off_polynomials(spark, order):
    x = np.random.default_rng(order).normal(size=300)
    scales = [8, 13, 25, 60]
    y, logs = np.cumsum(x - x.mean()), []
    for s in scales:
        left = [np.mean((seg - np.polyval(np.polyfit(np.arange(s), seg, order), np.arange(s))) ** 2) for seg in y[: 300 // s * s].reshape(-1, s)]
        logs.append(np.log(np.sqrt(np.mean(left))))
    assert features.dfa_alpha(recordings(spark, a=x), scales, order=order).first().dfa_alpha == pytest.approx(np.polyfit(np.log(scales), logs, 1)[0], abs=1e-8)
    with pytest.raises(ValueError):
        features.dfa_alpha(recordings(spark, a=x), [order + 1, 20], order=order)


def test_categories_do_not_meet_in_one_plan(spark):
    s = core.from_arrays(spark.createDataFrame([("a", np.random.default_rng(4).normal(size=300).tolist())], "rec string, values array<double>"), "rec", "values")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = features.extract(s, 64.0)
        made.collect()
        assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
