"""Forecasts by seasonal ARIMA models: every candidate of every recording is fitted in a task of its own, see functions/arima.py."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions.arima import TRENDS, Shape, ahead, fitted, fitted_each

#: Candidates (lags, differences, past errors) and trend terms: a level or a line, and with differences none or a drift.
GRID = [((p, d, q), trend) for p, d, q in itertools.product(range(4), range(2), range(3)) if p + d + q > 0 for trend in (("n", "t") if d else ("c", "ct"))]
FOLDS = 2
#: A model whose forecast moves by so many ranges of its history has failed.
DIVERGED = 10
#: Recordings whose models are looked for at once.
TOGETHER = 256


def shape_of(order: tuple[int, int, int], trend: str | None, season: int | None, seasonal_order: tuple[int, int, int]) -> Shape:
    """The model's shape; without a trend given, a constant if nothing is differenced and no term otherwise."""
    seasonal = seasonal_order if season else (0, 0, 0)
    differences = order[1] + seasonal[1]
    trend = trend or ("n" if differences else "c")
    if trend not in TRENDS:
        raise ValueError(f"a trend has to be one of {', '.join(TRENDS)}")
    if differences and "c" in trend or differences > 1 and trend == "t":
        raise ValueError("differences leave nothing of these trend terms")
    if min(*order, *seasonal) < 0 or season is not None and season < 2:
        raise ValueError("orders can't be negative, and a season has two samples or more")
    return Shape(*order, *seasonal, season or 1, trend)


def histories(samples: DataFrame, history: int, held: int = 0) -> DataFrame:
    """rec, n (samples in all) and x, the last `history` values ahead of the `held` last ones, of recordings without gaps there."""
    size = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    end = F.col("n") - held
    known = samples.join(size, "rec").where((F.col("idx") < end) & (F.col("idx") >= end - history))
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return known.groupBy("rec", "n").agg(F.transform(pairs, lambda p: p["value"]).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """By tasks of a fixed number: the rows are small, but each is much work, which adaptive execution doesn't see."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _models(batch: pd.DataFrame, shape: Shape) -> Iterator[tuple]:
    """(row, x, model) of the rows with a model, TOGETHER of them fitted side by side."""
    for a in range(0, len(batch), TOGETHER):
        rows = list(batch.iloc[a : a + TOGETHER].itertuples(index=False))
        xs = [np.asarray(r.x, float) for r in rows]
        yield from ((r, x, m) for r, x, m in zip(rows, xs, fitted_each(xs, shape), strict=True) if m is not None)


def arima(samples: DataFrame, order: tuple[int, int, int], trend: str | None = None, season: int | None = None, seasonal_order: tuple[int, int, int] = (1, 0, 1), history: int = 2000) -> DataFrame:
    """rec, n (samples seen), loglik, aic, variance, ar, ma, seasonal_ar, seasonal_ma and trend: the model of most exact likelihood
    of each recording's last `history` samples. Parameters are those of forecast(). Recordings with gaps there, or too short for
    the model, have no rows. A line's slope is told a sample.
    """
    shape = shape_of(order, trend, season, seasonal_order)
    kind = samples.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r, x, m in _models(batch, shape):
                ar, seasonal_ar, ma, seasonal_ma = shape.split(m.u)
                slopes = [b / float(len(x)) ** k for b, k in zip(m.trend, TRENDS[shape.trend], strict=True)]
                out.append((r.rec, len(x), m.loglik, m.aic, m.variance, ar, ma, seasonal_ar, seasonal_ma, slopes))
            yield pd.DataFrame(out, columns=["rec", "n", "loglik", "aic", "variance", "ar", "ma", "seasonal_ar", "seasonal_ma", "trend"])

    lists = ", ".join(f"{c} array<double>" for c in ("ar", "ma", "seasonal_ar", "seasonal_ma", "trend"))
    return _spread(histories(samples, history), "rec").select("rec", "x").mapInPandas(run, f"rec {kind}, n long, loglik double, aic double, variance double, {lists}")


def forecast(
    samples: DataFrame, steps: int, fs: float | None = None, order: tuple[int, int, int] | None = None, select: str = "cv", season: int | None = None, holdout: bool = False, history: int = 2000, level: float = 0.95,
    trend: str | None = None, seasonal_order: tuple[int, int, int] = (1, 0, 1),
) -> DataFrame:
    """rec, step, time, forecast, lower, upper, actual and model of the next `steps` values of each recording, or, with `holdout`,
    of its last ones, which the models don't see.

    A model has an `order` (lags, differences, past errors), for a `season` of so many samples a `seasonal_order` of the same
    kind, and a `trend`: n, c, t or ct, for no term, a constant, a line through 0 or both, of the series before differences, so that t
    with one difference is a drift. Without an order each of GRID is tried, with the trend's terms if one is given: `cv` takes the one
    whose forecasts from two earlier points miss by least on average, `aic` the one of least information criterion. A forecast
    further away than ten times the history's range counts as failed, and the next model takes its place. Models are fitted to
    the last `history` samples, which bounds a task's work; recordings with gaps there, or too short for any model, have no rows.
    """
    if select not in ("cv", "aic"):
        raise ValueError("select has to be cv or aic")
    if steps < 1:
        raise ValueError("there has to be a step")
    kind = samples.schema["rec"].dataType.simpleString()
    if order:
        shapes = [shape_of(order, trend, season, seasonal_order)]
    else:
        seasonal_differences = seasonal_order[1] if season else 0
        fits = lambda o, t: not (o[1] + seasonal_differences and "c" in t or o[1] + seasonal_differences > 1 and t == "t")
        shapes = [shape_of(o, t, season, seasonal_order) for o, t in GRID if fits(o, t) and trend in (None, t)]
        if not shapes:
            raise ValueError("no candidate has these trend terms")
    rows = histories(samples, history, steps if holdout else 0)
    tried = _spread(rows.withColumn("at", F.explode(F.array(*map(F.lit, range(len(shapes)))))), "rec", "at")

    def score(x: np.ndarray, shape: Shape, model) -> float | None:
        if len(shapes) == 1:
            return 0.0
        if select == "aic":
            return model.aic
        h, missed = max(1, min(steps, len(x) // (3 * FOLDS))), []
        for cut in range(len(x) - FOLDS * h, len(x), h):
            if (own := fitted(x[:cut], shape, model.u)) is None:
                return None
            missed.append(np.abs(ahead(x[:cut], own, h)[0] - x[cut : cut + h]).mean())
        return float(np.mean(missed))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r, x, model in (found for at, own in batch.groupby("at", sort=False) for found in _models(own, shapes[at])):
                shape = model.shape
                made = ahead(x, model, steps)
                if not np.abs(made[0] - x[-1]).max() <= DIVERGED * (np.ptp(x) or 1.0) or (s := score(x, shape, model)) is None:
                    continue
                seasonal = f" x ({shape.sp}, {shape.sd}, {shape.sq}, {shape.season})" if season else ""
                out.append((r.rec, r.n, s, r.at, f"({shape.p}, {shape.d}, {shape.q}){seasonal} {shape.trend}", *made))
            yield pd.DataFrame(out, columns=["rec", "n", "score", "at", "model", "forecast", "error"])

    found = tried.mapInPandas(judged, f"rec {kind}, n long, score double, at int, model string, forecast array<double>, error array<double>")
    best = found.groupBy("rec", "n").agg(F.min(F.struct("score", "at", "model", "forecast", "error")).alias("b"))
    each = best.select("rec", "n", "b.model", F.posexplode(F.arrays_zip("b.forecast", "b.error")).alias("at", "f"))
    z = _quantile((1 + level) / 2)
    idx = F.col("n") - (steps if holdout else 0) + F.col("at")
    out = each.select("rec", (F.col("at") + 1).alias("step"), idx.alias("idx"), F.col("f.forecast").alias("forecast"), (F.col("f.forecast") - z * F.col("f.error")).alias("lower"), (F.col("f.forecast") + z * F.col("f.error")).alias("upper"), "model")
    out = out.join(samples.select("rec", "idx", F.col("value").alias("actual")), ["rec", "idx"], "left")
    return out.select("rec", "step", (F.col("idx") / (fs or 1.0)).alias("time"), "forecast", "lower", "upper", "actual", "model")


def _quantile(p: float) -> float:
    """The standard normal's, by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(-middle / math.sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def metrics(forecasts: DataFrame, samples: DataFrame, fs: float | None = None) -> DataFrame:
    """rec, mae, rmse, mape (per cent, of actual values that aren't 0), coverage, mae_naive (of the last value before, held) and
    skill, 1 - mae / mae_naive, of forecasts with actual values."""
    f = forecasts.where("actual IS NOT NULL").withColumn("idx", F.round(F.col("time") * (fs or 1.0)).cast("long"))
    last = f.groupBy("rec").agg((F.min("idx") - 1).alias("idx")).join(samples, ["rec", "idx"]).select("rec", F.col("value").alias("last"))
    e, a = F.abs(F.col("actual") - F.col("forecast")), F.col("actual")
    out = f.join(last, "rec", "left").groupBy("rec").agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.abs(a) > 1e-12, e / F.abs(a)))).alias("mape"),
        F.avg(a.between(F.col("lower"), F.col("upper")).cast("int")).alias("coverage"), F.avg(F.abs(a - F.col("last"))).alias("mae_naive"),
    )
    return out.withColumn("skill", 1 - F.try_divide("mae", F.when(F.col("mae_naive") > 0, F.col("mae_naive"))))
