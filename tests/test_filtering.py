"""Filters against what a tone in and a tone out must be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.core import from_arrays
from undula.functions.signal import butterworth, sections, sections_from, steady, transition
from undula.operators import filtering, statistics

FS = 100.0


@pytest.fixture(scope="module")
def tones(spark):
    t = np.arange(2000) / FS
    rows = [("low", np.sin(2 * np.pi * 2 * t).tolist()), ("high", np.sin(2 * np.pi * 30 * t).tolist())]
    return from_arrays(spark.createDataFrame(rows, "rec string, values array<double>"), "rec", "values").cache()


def middle(df):
    rows = df.where("idx BETWEEN 300 AND 1699").groupBy("rec").agg(F.sqrt(F.avg(F.col("value") ** 2)).alias("rms")).collect()
    return {r.rec: r.rms * 2**0.5 for r in rows}


@pytest.mark.parametrize(("kind", "cutoff", "low", "high"), [("lowpass", 8.0, 1, 0), ("highpass", 8.0, 0, 1), ("bandpass", (20.0, 40.0), 0, 1), ("bandstop", (20.0, 40.0), 1, 0)])
def test_butterworth(tones, kind, cutoff, low, high):
    got = middle(filtering.butter(tones, kind, cutoff, FS))
    assert got["low"] == pytest.approx(low, abs=0.01)
    assert got["high"] == pytest.approx(high, abs=0.01)


def test_half_power_at_the_cutoff(spark):
    t = np.arange(4000) / FS
    s = from_arrays(spark.createDataFrame([("x", np.sin(2 * np.pi * 10 * t).tolist())], "rec string, values array<double>"), "rec", "values")
    out = filtering.butter(s, "lowpass", 10.0, FS, zero_phase=False).where("idx BETWEEN 1000 AND 2999")
    assert out.agg(F.sqrt(F.avg(F.col("value") ** 2))).first()[0] == pytest.approx(0.5, abs=1e-3)


def test_chunks_make_no_difference(tones):
    whole = filtering.butter(tones, "lowpass", 8.0, FS)
    parts = filtering.butter(tones, "lowpass", 8.0, FS, chunk=700).withColumnRenamed("value", "other")
    both = whole.join(parts, ["rec", "idx"])
    assert both.count() == 4000
    assert both.agg(F.max(F.abs(F.col("value") - F.col("other")))).first()[0] < 1e-8


def test_notch_fir_savgol(tones):
    got = middle(filtering.notch_filter(tones, 30.0, FS))
    assert got["high"] < 0.01 and got["low"] == pytest.approx(1, abs=0.01)
    got = middle(filtering.fir_filter(tones, 8.0, FS))
    assert got["high"] < 0.01 and got["low"] == pytest.approx(1, abs=0.01)
    smooth = filtering.savgol(tones, 11, 3).withColumnRenamed("value", "other").join(tones, ["rec", "idx"]).where("rec = 'low'")
    assert smooth.agg(F.max(F.abs(F.col("value") - F.col("other")))).first()[0] < 0.01


def test_parabola_comes_off(spark):
    x = np.linspace(-1, 1, 500)
    s = from_arrays(spark.createDataFrame([("x", (3 * x * x - 2 * x + 1).tolist())], "rec string, values array<double>"), "rec", "values")
    assert statistics.detrend_quadratic(s).agg(F.max(F.abs("value"))).first()[0] < 1e-9


def test_memories_are_carried():
    sos = butterworth(4, "bandpass", (1.0, 9.0), FS)
    x = np.random.default_rng(0).normal(size=(3, 500))
    start = np.random.default_rng(1).normal(size=(3, 4, 2))
    whole, end = sections_from(sos, x, start)
    first, middle_ = sections_from(sos, x[:, :123], start)
    rest, last = sections_from(sos, x[:, 123:], middle_)
    assert np.allclose(np.hstack([first, rest]), whole) and np.allclose(last, end)
    left = sections_from(sos, x, np.zeros_like(start))[1].reshape(3, -1)
    assert np.allclose(start.reshape(3, -1) @ transition(sos, 500).T + left, end.reshape(3, -1))
    low = butterworth(3, "lowpass", 5.0, FS)
    assert np.allclose(sections_from(low, np.ones((1, 50)), steady(low)[None])[0], 1)


def plain(sos, x, zero_phase):
    if not zero_phase:
        return sections(sos, x[None])[0]
    return filtering._both_ways(sos, x[None])[0]


@pytest.mark.parametrize("zero_phase", [True, False])
@pytest.mark.parametrize(("kind", "cutoff"), [("highpass", 0.001), ("lowpass", 0.02), ("bandpass", (0.01, 20.0))])
def test_long_memories_at_any_cutoff(spark, kind, cutoff, zero_phase):
    """Filters that remember far more than a chunk, on recordings of many chunks, one, less than one, and too few samples."""
    draw = np.random.default_rng(5)
    recordings = {"long": draw.normal(size=5003).cumsum(), "even": draw.normal(size=1400) + 3, "short": draw.normal(size=90) - 2, "few": draw.normal(size=5)}
    s = from_arrays(spark.createDataFrame([(k, v.tolist()) for k, v in recordings.items()], "rec string, values array<double>"), "rec", "values")
    sos = butterworth(4, kind, cutoff, FS)
    got = {}
    for r in filtering.butter(s, kind, cutoff, FS, zero_phase=zero_phase, chunk=700).orderBy("rec", "idx").collect():
        got.setdefault(r.rec, []).append(r.value)
    for k, x in recordings.items():
        want = plain(sos, x, zero_phase)
        if np.isnan(want).any():
            assert got[k] == [None] * len(x)
        else:
            assert np.abs(np.array(got[k]) - want).max() < 1e-6 * max(1, np.abs(want).max()), k


def test_samples_are_read_a_fixed_number_of_times(spark):
    """However low the cut-off, no sample stands in more than one chunk."""
    s = spark.range(3000).selectExpr("'a' AS rec", "id AS idx", "sin(id / 50) AS value")
    for cutoff in (0.01, 0.0001):
        plan = filtering.butter(s, "lowpass", cutoff, FS, chunk=500)._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence" not in plan
