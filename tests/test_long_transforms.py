"""Transforms laid out over tasks against NumPy's and those within one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula import core
from undula.core import from_arrays
from undula.functions.signal import wavelet_kernel
from undula.operators import fourier, long_wavelet, spectral


def recordings(spark, **values):
    rows = [(k, [None if np.isnan(v) else float(v) for v in x]) for k, x in values.items()]
    return from_arrays(spark.createDataFrame(rows, "rec string, values array<double>"), "rec", "values")


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(core, "LONG", 8)
    monkeypatch.setattr(core, "CHUNK", 16)
    monkeypatch.setattr(fourier, "SIDE", 32)


LENGTHS = (9, 11, 37, 60, 64, 97, 254, 131, 257, 360)  # squares, products, primes that fit a line or don't, twice a prime


@pytest.mark.parametrize("inverse", [False, True])
def test_any_length(spark, narrow, inverse):
    draw = np.random.default_rng(1)
    z = {f"n{n}": draw.normal(size=n) + 1j * draw.normal(size=n) for n in LENGTHS}
    values = spark.createDataFrame([(k, i, float(v.real), float(v.imag)) for k, x in z.items() for i, v in enumerate(x)], "rec string, idx long, re double, im double")
    lengths = spark.createDataFrame([(k, len(x)) for k, x in z.items()], "rec string, n long")
    got = {}
    for r in fourier.transformed(values, lengths, inverse).collect():
        got.setdefault(r.rec, {})[r.idx] = r.re + 1j * r.im
    assert set(got) == set(z)
    for k, x in z.items():
        want = np.fft.ifft(x) if inverse else np.fft.fft(x)
        assert sorted(got[k]) == list(range(len(x))) and np.allclose([got[k][i] for i in range(len(x))], want, atol=1e-10)


def test_too_long(spark, narrow):
    lengths = spark.createDataFrame([("a", 521)], "rec string, n long")
    with pytest.raises(ValueError, match="too long"):
        fourier.transformed(spark.createDataFrame([("a", 0, 1.0, 0.0)], "rec string, idx long, re double, im double"), lengths)


@pytest.mark.parametrize("window", ["hann", "blackman", "boxcar"])
def test_spectra_are_those_of_one_task(spark, narrow, monkeypatch, window):
    draw = np.random.default_rng(2)
    s = recordings(spark, even=draw.normal(size=120), prime=draw.normal(size=101), short=draw.normal(size=7), gappy=np.r_[draw.normal(size=50), np.nan]).cache()
    keyed = lambda df: {(r.rec, r.bin): r for r in df.collect()}
    got = keyed(spectral.fft(s, 50.0, window))
    monkeypatch.setattr(core, "LONG", 1 << 16)
    want = keyed(spectral.fft(s, 50.0, window))
    assert set(got) == set(want) and not any(k[0] == "gappy" for k in got)
    for k, r in want.items():
        assert (got[k].freq, got[k].magnitude, got[k].power) == pytest.approx((r.freq, r.magnitude, r.power), abs=1e-10)
        assert r.magnitude < 1e-9 or np.exp(1j * got[k].phase) == pytest.approx(np.exp(1j * r.phase), abs=1e-6)


def test_envelopes_are_those_of_one_task(spark, narrow, monkeypatch):
    t, draw = np.arange(150), np.random.default_rng(3)
    s = recordings(spark, a=np.cos(0.7 * t) + 0.1 * draw.normal(size=150), b=np.sin(0.3 * t[:113]) + 0.1 * draw.normal(size=113), c=draw.normal(size=6)).cache()
    keyed = lambda df: {(r.rec, r.idx): (r.envelope, r.phase, r.frequency) for r in df.collect()}
    got = keyed(spectral.hilbert(s, 10.0))
    monkeypatch.setattr(core, "LONG", 1 << 16)
    want = keyed(spectral.hilbert(s, 10.0))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())


def test_a_long_tone(spark):
    n = 200_003  # a prime
    s = spark.range(n).select(F.lit("a").alias("rec"), F.col("id").alias("idx"), F.sin(F.col("id") * (2 * np.pi * 1000 / n)).alias("value"))
    top = spectral.fft(s, 1.0, "boxcar").orderBy(F.desc("magnitude")).limit(2).collect()
    assert top[0].bin == 1000 and top[0].magnitude == pytest.approx(1, abs=1e-9) and top[1].magnitude < 1e-8


@pytest.mark.parametrize("name", ["cmor1.5-1.0", "cmor2.5-0.5", "mexh", "gaus1", "morl"])
def test_wavelets_are_those_of_one_task(spark, monkeypatch, name):
    monkeypatch.setattr(long_wavelet, "LEAST", 16)
    draw = np.random.default_rng(4)
    x = draw.normal(size=230)
    s = recordings(spark, a=x, b=draw.normal(size=131), c=draw.normal(size=20)).cache()
    freqs = [0.3, 1.0, 2.5, 7.0]  # from wavelets of several recordings' length to one of a few samples
    keyed = lambda df: {(r.rec, r.freq, r.idx): (r.re, r.im, r.magnitude) for r in df.collect()}
    want = keyed(spectral.wavelet(s, freqs, 20.0, name))
    monkeypatch.setattr(core, "LONG", 64)
    got = keyed(spectral.wavelet(s, freqs, 20.0, name))
    assert set(got) == set(want) and len(want) == 4 * 381 and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    # By plain sums of the integral times the samples' steps.
    root, kernel = wavelet_kernel(name, 2.5, 20.0)
    back = (len(kernel) - 2) // 2 + 1
    step = np.diff(np.r_[0, x, 0])
    for i in (0, 5, 100, 229):
        c = -root * sum(kernel[k] * step[i + back - k] for k in range(len(kernel)) if 0 <= i + back - k <= 230)
        assert got["a", 2.5, i][:2] == pytest.approx((c.real, c.imag), abs=1e-9)


def test_unknown_wavelets(spark):
    for name, freqs in (("haar", [1.0]), ("cmor0-1", [1.0]), ("mexh", []), ("mexh", [0.0])):
        with pytest.raises(ValueError):
            spectral.wavelet(recordings(spark, a=[1.0, 2.0]), freqs, 1.0, name)
