"""Seasonal ARIMA models against dense covariances, exhaustive search and the processes that made the series."""

import itertools
import math

import numpy as np
import pytest

from undula.functions import arima
from undula.functions.arima import Shape
from undula.operators import forecast


def process(n, ar=(), ma=(), seed=1, spare=300):
    e, y = np.random.default_rng(seed).normal(size=n + spare), np.zeros(n + spare)
    for t in range(n + spare):
        y[t] = e[t] + sum(c * y[t - 1 - k] for k, c in enumerate(ar) if t > k) + sum(c * e[t - 1 - k] for k, c in enumerate(ma) if t > k)
    return y[spare:]


def samples(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "rec string, idx long, value double")


def dense(columns, ar, ma):
    """The likelihood from the covariance matrix of all samples."""
    n, m = len(columns), 3000
    psi = np.zeros(m)
    for k in range(m):
        psi[k] = (1.0 if k == 0 else ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(len(ar), k)))
    covariance = np.array([psi[: m - k] @ psi[k:] for k in range(n)])[np.abs(np.subtract.outer(range(n), range(n)))]
    y, x, inverse = columns[:, 0], columns[:, 1:], np.linalg.inv(covariance)
    e = y - x @ np.linalg.lstsq(x.T @ inverse @ x, x.T @ inverse @ y, rcond=None)[0] if x.shape[1] else y
    return -n / 2 * (math.log(2 * math.pi * (e @ inverse @ e) / n) + 1) - np.linalg.slogdet(covariance)[1] / 2


@pytest.mark.parametrize(
    ("shape", "u"),
    [
        (Shape(2, 0, 1, trend="ct"), [0.5, -0.3, 0.4]), (Shape(0, 0, 2), [0.5, -0.9]), (Shape(3, 0, 0, trend="c"), [0.5, -0.3, 0.4]), (Shape(1, 0, 1, 1, 0, 1, 7, "c"), [0.5, 0.6, -0.3, -0.4]),
        (Shape(1, 1, 1, trend="t"), [0.2, -0.6]), (Shape(0, 1, 1, 0, 1, 1, 4), [-0.4, -0.5]),
    ],
)
@pytest.mark.parametrize("n", [20, 259])
def test_likelihood(shape, u, n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    columns = arima.differenced(np.column_stack([x, shape.regressors(0, n, n)]), shape.differences())
    assert arima.likelihood(columns, shape, np.array(u)).loglik == pytest.approx(dense(columns, *arima.polynomials(shape, np.array(u))), abs=1e-3)


@pytest.mark.parametrize("shape", [Shape(1, 0, 1, trend="c"), Shape(2, 1, 1, trend="t"), Shape(1, 0, 0, 1, 0, 1, 7, trend="ct"), Shape(3, 1, 2), Shape(0, 0, 0, trend="c")])
def test_models_side_by_side(shape):
    """Short series have the models that each has alone by the plain filter, whatever others there are."""
    draw = np.random.default_rng(4)
    xs = [draw.exponential(50, n) for n in (40, 3, 67, 67, 99, 300)]
    found = arima.fitted_each(xs, shape)
    assert [m is None for m in found] == [len(x) < 4 for x in xs] and arima.fitted_each([], shape) == []
    for x, m in zip(xs, found, strict=True):
        if m is None:
            continue
        columns = arima.differenced(np.column_stack([x, shape.regressors(0, len(x), len(x))]), shape.differences())
        plain = arima.likelihood(columns, shape, m.u)
        assert m.loglik == pytest.approx(plain.loglik, abs=1e-7) and m.trend == pytest.approx(plain.trend, rel=1e-6)
    again = arima.fitted_each(xs[2:0:-1] + xs[3:5], shape)
    assert (again[0].loglik, again[0].u.tolist()) == (found[2].loglik, found[2].u.tolist())


def test_processes_are_recovered(spark):
    n = 1500
    s = samples(spark, arma=5 + process(n, (0.6, -0.3), (0.4,), 2), ma=process(n, (), (-0.5,), 3))
    got = {r.rec: r for r in forecast.arima(s, (2, 0, 1)).collect()}
    assert got["arma"].ar == pytest.approx([0.6, -0.3], abs=0.2) and got["arma"].ma == pytest.approx([0.4], abs=0.2) and got["arma"].trend == pytest.approx([5], abs=4 * (1.4 / 0.7) / math.sqrt(n))
    assert got["arma"].variance == pytest.approx(1, abs=4 * math.sqrt(2 / n)) and got["arma"].aic == pytest.approx(10 - 2 * got["arma"].loglik)
    # Standard errors by theory: sqrt((1 - c^2) / n) for one coefficient.
    one = forecast.arima(samples(spark, x=process(n, (0.7,), (), 4)), (1, 0, 0)).first()
    assert one.ar == pytest.approx([0.7], abs=3 * math.sqrt(0.51 / n))
    drift = forecast.arima(samples(spark, x=process(n, (), (-0.5,), 5).cumsum() + 0.2 * np.arange(n)), (0, 1, 1), "t").first()
    assert drift.ma == pytest.approx([-0.5], abs=3 * math.sqrt(0.75 / n)) and drift.trend == pytest.approx([0.2], abs=3 * 0.5 / math.sqrt(n))
    lags = np.zeros(13)
    lags[0], lags[11], lags[12] = 0.5, 0.7, -0.35
    seasonal = forecast.arima(samples(spark, x=process(n, lags, (), 6)), (1, 0, 0), season=12, seasonal_order=(1, 0, 0)).first()
    assert seasonal.ar == pytest.approx([0.5], abs=3 * math.sqrt(0.75 / n)) and seasonal.seasonal_ar == pytest.approx([0.7], abs=3 * math.sqrt(0.51 / n))


def test_intervals_hold_what_they_promise(spark):
    s = samples(spark, **{f"x{k}": process(260, (0.7,), (0.3,), 100 + k) for k in range(60)})
    m = forecast.forecast(s, 10, order=(1, 0, 1), holdout=True, level=0.9)
    rows = m.collect()
    assert len(rows) == 600 and np.mean([r.lower <= r.actual <= r.upper for r in rows]) == pytest.approx(0.9, abs=0.05)
    far = [r for r in rows if r.step == 10]
    # Ten steps on, the error is nearly the process's own: variance (1 + 2 * 0.7 * 0.3 + 0.3 ** 2) / (1 - 0.7 ** 2).
    assert np.mean([(r.upper - r.lower) / 2 / 1.645 for r in far]) == pytest.approx(math.sqrt(1.51 / 0.51), rel=0.1)


def test_forecasts_follow_their_recursion():
    x = process(200, (0.5,), (), 9).cumsum() + 3 * np.arange(200)
    model = arima.fitted(x, Shape(1, 1, 0, trend="t"))
    values, errors = arima.ahead(x, model, 3)
    (phi,), slope = Shape(1, 1, 0).split(model.u)[0], model.trend[0] / 200
    want, last = [], list(x)
    for _ in range(3):
        last.append(last[-1] + slope + phi * (last[-1] - last[-2] - slope))
        want.append(last[-1])
    assert values == pytest.approx(want) and errors**2 == pytest.approx(model.variance * np.cumsum([1, (1 + phi) ** 2, (1 + phi + phi**2) ** 2]))


def test_order_of_least_aic(spark, monkeypatch):
    grid = [((p, 0, q), "c") for p, q in itertools.product(range(3), range(2)) if p + q]
    monkeypatch.setattr(forecast, "GRID", grid)
    x = process(150, (0.5, 0.3), (), 11)

    def best(o):  # the dense likelihood on a grid of parameters, then on finer ones around its best
        shape = Shape(*o, trend="c")
        columns = np.column_stack([x, np.ones(150)])
        at, width = np.zeros(shape.free), 1.5
        for _ in range(7):
            at = max((at + width * np.array(k) for k in itertools.product((-1, -0.5, 0, 0.5, 1), repeat=shape.free)), key=lambda u: arima.likelihood(columns, shape, u).loglik)
            width /= 1.8
        return 2 * (shape.free + 2) - 2 * dense(columns, *arima.polynomials(shape, at))

    exact = {o: best(o) for o, _ in grid}
    for o, _ in grid:
        assert arima.fitted(x, Shape(*o, trend="c")).aic <= exact[o] + 0.02
    got = forecast.forecast(samples(spark, x=x), 3, select="aic").first()
    assert got.model == f"{min(exact, key=exact.get)} c"


def test_seasons_and_odd_series(spark):
    t = np.arange(300)
    wave = 10 + 3 * np.sin(2 * np.pi * t / 12) + 0.2 * np.random.default_rng(3).normal(size=300)
    s = samples(spark, wave=wave, short=[1.0, 2.0, 1.0], constant=np.full(40, 7.0), line=2.0 * np.arange(60))
    rows = forecast.forecast(s, 12, order=(1, 0, 0), season=12, holdout=True).collect()
    assert np.abs([r.forecast - r.actual for r in rows if r.rec == "wave"]).mean() < 0.3 and {r.model for r in rows} == {"(1, 0, 0) x (1, 0, 1, 12) c"}
    assert all(r.forecast == pytest.approx(7) for r in rows if r.rec == "constant") and not [r for r in rows if r.rec == "short"]
    drift = forecast.forecast(s.where("rec = 'line'"), 4, order=(0, 1, 0), trend="t").orderBy("step").collect()
    assert [r.forecast for r in drift] == pytest.approx([120, 122, 124, 126])
    for bad in ({"order": (1, 1, 0), "trend": "c"}, {"order": (1, 0, 0), "trend": "x"}, {"order": (1, 0, 0), "season": 1}, {"select": "luck"}, {"order": (-1, 0, 0)}):
        with pytest.raises(ValueError):
            forecast.forecast(s, 3, **bad)
