"""Shapiro-Wilk and augmented Dickey-Fuller tests against published figures and plain regressions."""

import math

import numpy as np
import pytest

from undula.core import from_arrays
from undula.functions.special import dickey_fuller, lag_rows, normal_quantile, normal_tail, p_of_dickey_fuller, shapiro_wilk
from undula.operators import statistics

#: Two samples with W and p as published.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704
TIMES = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.900473, 0.042090


def test_normal_quantiles():
    p = np.array([1e-12, 1e-5, 0.025, 0.3, 0.5, 0.9, 0.999])
    z = normal_quantile(p)
    assert z[2] == pytest.approx(-1.959963985, abs=1e-8) and z[4] == pytest.approx(0, abs=1e-12)
    assert np.allclose(normal_tail(z) / 2, np.minimum(p, 1 - p), rtol=1e-8)


@pytest.mark.parametrize("x,w,p", [MEN, TIMES])
def test_published_shapiro_wilk(x, w, p):
    got = shapiro_wilk(np.sort(np.array(x, float)))
    assert got[0] == pytest.approx(w, abs=5e-5) and got[1] == pytest.approx(p, abs=5e-5)


def test_shapiro_wilk_levels():
    draw = np.random.default_rng(0)
    for n in (3, 5, 11, 12, 60):
        p = [shapiro_wilk(np.sort(draw.normal(size=n)))[1] for _ in range(600)]
        assert 0.02 < np.mean(np.array(p) < 0.05) < 0.09
    assert shapiro_wilk(np.sort(draw.exponential(size=80)))[1] < 1e-4


def test_shapiro_wilk_of_recordings(spark):
    draw = np.random.default_rng(1)
    rows = {"men": MEN[0], "times": TIMES[0], "two": [1, 2], "same": [3] * 9, "gaps": [None, *MEN[0], None], "long": draw.normal(size=9000).tolist(), "skew": draw.exponential(size=9000).tolist()}
    s = from_arrays(spark.createDataFrame([(k, [None if v is None else float(v) for v in x]) for k, x in rows.items()], "rec string, values array<double>"), "rec", "values")
    got = {r.rec: r for r in statistics.shapiro(s).collect()}
    for k, (_, w, p) in {"men": MEN, "times": TIMES, "gaps": MEN}.items():
        assert got[k].w == pytest.approx(w, abs=5e-5) and got[k].p == pytest.approx(p, abs=5e-5)
    assert got["two"].w is None and got["same"].p is None and got["long"].n == 9000 and got["long"].used == 5000
    assert got["long"].p > 0.001 and got["skew"].p < 1e-10


def plainly(x):
    """Lags by exhaustive least squares on shared rows, then the statistic on all rows of the chosen one."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    best = None
    for lags in range(most + 1):
        rows = lag_rows(x, lags)[most - lags :]
        beta = np.linalg.lstsq(rows[:, 1:], rows[:, 0], rcond=None)[0]
        left = ((rows[:, 0] - rows[:, 1:] @ beta) ** 2).sum()
        aic = len(rows) * (math.log(left / len(rows)) + 1 + math.log(2 * math.pi)) + 2 * (lags + 2)
        best = min(best or (math.inf, 0), (aic, lags))
    rows = lag_rows(x, best[1])
    beta = np.linalg.lstsq(rows[:, 1:], rows[:, 0], rcond=None)[0]
    left = ((rows[:, 0] - rows[:, 1:] @ beta) ** 2).sum() / (len(rows) - best[1] - 2)
    return best[1], beta[1] / math.sqrt(left * np.linalg.inv(rows[:, 1:].T @ rows[:, 1:])[1, 1])


def series():
    draw = np.random.default_rng(3)
    e = draw.normal(size=4000)
    out = {"walk": e[:500].cumsum(), "white": e[500:800], "short": e[800:815]}
    ar = np.zeros(900)
    for i in range(4, 900):
        ar[i] = 0.4 * ar[i - 1] + 0.3 * ar[i - 4] + e[1000 + i]
    return out | {"ar": ar + 50, "long walk": e.cumsum()}


def test_dickey_fuller_of_recordings(spark, monkeypatch):
    monkeypatch.setattr(statistics, "CHUNK", 700)
    rows = [(k, x.tolist()) for k, x in series().items()] + [("same", [1.0] * 60), ("few", [1.0, 2.0, 4.0]), ("none", [None] * 5)]
    s = from_arrays(spark.createDataFrame(rows, "rec string, values array<double>"), "rec", "values")
    got = {r.rec: r for r in statistics.stationarity_adf(s).collect()}
    for k, x in series().items():
        lags, t = plainly(x)
        assert got[k].lags == lags and got[k].adf == pytest.approx(t, rel=1e-6) and got[k].p == pytest.approx(p_of_dickey_fuller(t), rel=1e-5)
    assert got["white"].stationary and got["ar"].stationary and not got["walk"].stationary and not got["long walk"].stationary
    assert all(got[k].adf is None and got[k].p is None for k in ("same", "few", "none"))


def test_p_of_dickey_fuller():
    assert p_of_dickey_fuller(-2.8616) == pytest.approx(0.05, abs=0.002) and p_of_dickey_fuller(-3.4304) == pytest.approx(0.01, abs=0.001)
    assert p_of_dickey_fuller(-40) == 0 and p_of_dickey_fuller(3) == 1
    x = np.random.default_rng(0).normal(size=40)
    assert dickey_fuller(lag_rows(x, 3).T @ lag_rows(x, 3), x[:5], 36) is not None
