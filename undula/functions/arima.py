"""Seasonal ARIMA models of one short series: exact likelihood by a Kalman filter, its maximum, and forecasts.

Trend terms are regressors of the series itself, so a linear term of a series differenced once is its drift. What they leave is
differenced, and follows an ARMA process whose polynomials are products of plain and seasonal ones. Both are kept stationary and
invertible by partial autocorrelations as parameters. Trend coefficients and the variance maximize the likelihood in closed form.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

#: Trend terms: none, constant, linear, both.
TRENDS = {"n": (), "c": (0,), "t": (1,), "ct": (0, 1)}
#: The filter's gain counts as settled once its covariance changes by less than this part; from there blocks of so many samples
#: are filtered at once.
SETTLED, BLOCK = 1e-7, 64
#: Series of up to SHORT samples, with states of up to SLIM numbers, are filtered side by side, MANY at once, each filled up to a
#: multiple of FILL samples.
SHORT, SLIM, MANY, FILL = 256, 16, 1024, 32
#: The largest partial autocorrelation, and the step of numeric slopes.
EDGE, SLOPE = 0.9999, 1e-5


@dataclass(frozen=True)
class Shape:
    """Numbers of coefficients: lags, differences and past errors, plain and seasonal, the period and the trend."""

    p: int
    d: int
    q: int
    sp: int = 0
    sd: int = 0
    sq: int = 0
    season: int = 1
    trend: str = "n"

    @property
    def free(self) -> int:
        return self.p + self.q + self.sp + self.sq

    def split(self, u: np.ndarray) -> list[np.ndarray]:
        """Plain and seasonal lags, then plain and seasonal past errors, of unbounded parameters."""
        parts = np.split(EDGE * np.tanh(u), np.cumsum([self.p, self.sp, self.q])[:3], axis=-1)
        lags, seasonal, errors, seasonal_errors = map(stationary, parts)
        return [lags, seasonal, -errors, -seasonal_errors]

    def differences(self) -> np.ndarray:
        """The polynomial 1 - ... that takes the differences."""
        out = np.ones(1)
        for every, times in ((1, self.d), (self.season, self.sd)):
            for _ in range(times):
                out = np.convolve(out, spaced(np.ones(1), every))
        return out

    def regressors(self, start: int, stop: int, n: int) -> np.ndarray:
        at = np.arange(start, stop) / n
        return np.stack([at**k for k in TRENDS[self.trend]], 1) if TRENDS[self.trend] else np.empty((stop - start, 0))


@dataclass(frozen=True)
class Model:
    shape: Shape
    u: np.ndarray
    trend: np.ndarray
    variance: float
    loglik: float

    @property
    def aic(self) -> float:
        return 2 * (self.shape.free + len(self.trend) + 1) - 2 * self.loglik


def stationary(partial: np.ndarray) -> np.ndarray:
    """Coefficients of the autoregressions with these partial autocorrelations, along the last axis."""
    out = partial[..., :0]
    for k in range(partial.shape[-1]):
        r = partial[..., k : k + 1]
        out = np.concatenate([out - r * out[..., ::-1], r], axis=-1)
    return out


def spaced(coefficients: np.ndarray, every: int) -> np.ndarray:
    """The polynomial 1 - c1 B^every - c2 B^(2 every) - ..., along the last axis."""
    out = np.zeros((*coefficients.shape[:-1], coefficients.shape[-1] * every + 1))
    out[..., 0] = 1
    out[..., every::every] = -coefficients
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of polynomials along the last axis; `b` is mostly zeros."""
    out = np.zeros((*a.shape[:-1], a.shape[-1] + b.shape[-1] - 1))
    for k in range(b.shape[-1]):
        if b[..., k].any():
            out[..., k : k + a.shape[-1]] += a * b[..., k : k + 1]
    return out


def polynomials(shape: Shape, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of all lags and of all past errors, with the seasonal ones multiplied in, for each row of parameters."""
    lags, seasonal, errors, seasonal_errors = shape.split(u)
    ar = -product(spaced(lags, 1), spaced(seasonal, shape.season))[..., 1:]
    return ar, product(spaced(-errors, 1), spaced(-seasonal_errors, shape.season))[..., 1:]


def differenced(x: np.ndarray, polynomial: np.ndarray) -> np.ndarray:
    """Columns with the polynomial applied; the first rows, which have no past, are left out."""
    lost = len(polynomial) - 1
    return sum(c * x[lost - k : len(x) - k] for k, c in enumerate(polynomial) if c)


def _moved(state: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """The transition: row 0 through the lags, the others up by one."""
    out = np.multiply.outer(lags, state[0])
    out[:-1] += state[1:]
    return out


def innovations(columns: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors of each column, their variances in parts of the process's, and the state after the last sample.

    The Kalman filter starts from the stationary covariance. When its gain has settled, errors are a fixed linear map of the
    state and of the samples so far, so whole blocks are multiplied by it.
    """
    n, k = columns.shape
    size = max(len(ar), len(ma) + 1)
    lags = np.r_[ar, np.zeros(size - len(ar))]
    noise = np.r_[1.0, ma, np.zeros(size - len(ma) - 1)]
    v0 = np.outer(noise, noise)
    cov, power = v0, np.eye(size, k=1)
    power[:, 0] += lags
    for _ in range(60):  # the sum of the noise's images, twice as many each time
        more = power @ cov @ power.T
        cov, power = cov + more, power @ power
        if np.abs(more).max() <= 1e-13 * cov.max():
            break
    state, errors, scale = np.zeros((size, k)), np.empty((n, k)), np.empty(n)
    at = 0
    while at < n:
        scale[at] = f = max(cov[0, 0], 1.0)  # no less than the noise to come, but for rounding
        gain = _moved(cov[:, :1], lags)[:, 0] / f
        errors[at] = columns[at] - state[0]
        state = _moved(state, lags) + np.outer(gain, errors[at])
        after = _moved(_moved(cov, lags).T, lags).T + v0 - f * np.outer(gain, gain)
        change, cov = np.abs(after - cov).max(), after
        at += 1
        if change <= SETTLED * cov.max():
            break
    scale[at:] = max(cov[0, 0], 1.0)
    if n - at < BLOCK:
        for i in range(at, n):
            errors[i] = columns[i] - state[0]
            state = _moved(state, lags) + np.outer(gain, errors[i])
        return errors, scale, state
    # The state moves by `step` without errors of its own: see `seen`, what the next samples are told by it, row by row.
    step = np.eye(size, k=1)
    step[:, 0] += lags - gain
    seen, sent = np.zeros((BLOCK, size)), np.zeros((size, BLOCK))
    row, column = np.eye(1, size)[0], gain
    for i in range(BLOCK):
        seen[i], sent[:, BLOCK - 1 - i] = row, column
        row, column = np.r_[row @ (lags - gain), row[:-1]], _moved(column[:, None], lags - gain)[:, 0]
    reply = np.r_[0.0, seen[:-1] @ gain]
    lower = np.tril(reply[np.abs(np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)))])
    far = np.linalg.matrix_power(step, BLOCK)
    while n - at >= BLOCK:
        y = columns[at : at + BLOCK]
        errors[at : at + BLOCK] = y - seen @ state - lower @ y
        state = far @ state + sent @ y
        at += BLOCK
    for i in range(at, n):
        errors[i] = columns[i] - state[0]
        state = _moved(state, lags) + np.outer(gain, errors[i])
    return errors, scale, state


def likelihood(columns: np.ndarray, shape: Shape, u: np.ndarray) -> Model:
    """The model with these parameters of the differenced series, column 0, and regressors, the others."""
    errors, scale, _ = innovations(columns, *polynomials(shape, u))
    e = errors / np.sqrt(scale)[:, None]
    if not np.isfinite(e).all():  # parameters at the edge, where rounding has taken over
        return Model(shape, u, np.zeros(e.shape[1] - 1), math.inf, -math.inf)
    trend = np.linalg.lstsq(e[:, 1:], e[:, 0], rcond=None)[0] if e.shape[1] > 1 else np.empty(0)
    left = e[:, 0] - e[:, 1:] @ trend
    n = len(left)
    variance = max(float(left @ left) / n, 1e-20 * float(columns[:, 0] @ columns[:, 0]) / n, 1e-280)
    return Model(shape, u, trend, variance, -n / 2 * (math.log(2 * math.pi * variance) + 1) - float(np.log(scale).sum()) / 2)


def _moved_each(states: np.ndarray, lags: np.ndarray) -> np.ndarray:
    out = lags[:, :, None] * states[:, :1]
    out[:, :-1] += states[:, 1:]
    return out


def innovations_each(columns: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The errors and variances of innovations() for many series of equal length, each with coefficients of its own, step by step
    side by side; shorter series may be filled up behind."""
    count, n, k = columns.shape
    size = max(ar.shape[1], ma.shape[1] + 1)
    lags, noise = np.zeros((count, size)), np.zeros((count, size))
    lags[:, : ar.shape[1]], noise[:, 0], noise[:, 1 : ma.shape[1] + 1] = ar, 1, ma
    v0 = noise[:, :, None] * noise[:, None]
    cov, power, going = v0, np.tile(np.eye(size, k=1), (count, 1, 1)), np.ones(count, bool)
    power[:, :, 0] += lags
    for _ in range(60):
        more = np.where(going[:, None, None], power @ cov @ power.transpose(0, 2, 1), 0)
        cov, power = cov + more, np.where(going[:, None, None], power @ power, 0)
        going &= ~(np.abs(more).max((1, 2)) <= 1e-13 * cov.max((1, 2)))
        if not going.any():
            break
    state, errors, scale = np.zeros((count, size, k)), np.empty((n, count, k)), np.empty((n, count))
    going, f, gain = np.ones(count, bool), np.ones(count), np.zeros((count, size))
    for at in range(n):
        if moving := going.any():
            f = np.where(going, np.maximum(cov[:, 0, 0], 1.0), f)
            gain = np.where(going[:, None], _moved_each(cov[:, :, :1], lags)[:, :, 0] / f[:, None], gain)
        scale[at] = f
        errors[at] = columns[:, at] - state[:, 0]
        state = _moved_each(state, lags) + gain[:, :, None] * errors[at][:, None]
        if moving:
            after = _moved_each(_moved_each(cov, lags).transpose(0, 2, 1), lags).transpose(0, 2, 1) + v0 - (f[:, None] * gain)[:, :, None] * gain[:, None]
            change = np.abs(after - cov).max((1, 2))
            cov = np.where(going[:, None, None], after, cov)
            settled = going & (change <= SETTLED * cov.max((1, 2)))
            f = np.where(settled, np.maximum(cov[:, 0, 0], 1.0), f)
            going &= ~settled
    return errors.transpose(1, 0, 2), scale.T


def likelihoods(series: list[np.ndarray], shape: Shape, us: list[np.ndarray]) -> list[Model]:
    """likelihood() of each series with its parameters."""
    if shape.p + shape.sp * shape.season > SLIM or shape.q + shape.sq * shape.season >= SLIM or len(series) < 2:
        return [likelihood(columns, shape, u) for columns, u in zip(series, us, strict=True)]
    out: list[Model | None] = [likelihood(c, shape, u) if len(c) > SHORT else None for c, u in zip(series, us, strict=True)]
    # Filled up to a length that hangs on a series' own alone, so that its sums are the same beside any others.
    filled: dict[int, list[int]] = {}
    for i, c in enumerate(series):
        if len(c) <= SHORT:
            filled.setdefault(-(-len(c) // FILL) * FILL, []).append(i)
    for length, own in ((k, v[a : a + MANY]) for k, v in filled.items() for a in range(0, len(v), MANY)):
        n = np.array([len(series[i]) for i in own])
        columns = np.zeros((len(own), length, series[own[0]].shape[1]))
        for row, i in zip(columns, own, strict=True):
            row[: len(series[i])] = series[i]
        there = np.arange(length) < n[:, None]
        with np.errstate(all="ignore"):
            errors, scale = innovations_each(columns, *polynomials(shape, np.stack([us[i] for i in own])))
            scale = np.where(there, scale, 1.0)
            e = np.where(there[:, :, None], errors / np.sqrt(scale)[:, :, None], 0.0)
        finite = np.isfinite(e).all((1, 2))
        e[~finite] = 0
        if e.shape[2] > 1:
            trend = (np.linalg.pinv(e[:, :, 1:], rcond=length * np.finfo(float).eps) @ e[:, :, :1])[:, :, 0]
            left = e[:, :, 0] - (e[:, :, 1:] @ trend[:, :, None])[:, :, 0]
        else:
            trend, left = np.zeros((len(own), 0)), e[:, :, 0]
        power = (columns[:, :, 0] ** 2).sum(1)
        variance = np.maximum(np.maximum((left * left).sum(1) / n, 1e-20 * power / n), 1e-280)
        value = -n / 2 * (np.log(2 * np.pi * variance) + 1) - np.log(np.where(finite[:, None], scale, 1.0)).sum(1) / 2
        for j, i in enumerate(own):
            out[i] = Model(shape, us[i], trend[j], float(variance[j]), float(value[j])) if finite[j] else Model(shape, us[i], trend[j], math.inf, -math.inf)
    return out


def lowest(x: np.ndarray, rounds: int = 40) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """A local minimum by BFGS with numeric slopes and halved steps: asks for the values at rows of points."""
    moves = SLOPE * np.eye(len(x))

    def around(x: np.ndarray) -> Generator[np.ndarray, np.ndarray, tuple[float, np.ndarray]]:
        found = yield np.concatenate([x[None], x + moves, x - moves])
        return found[0], (found[1 : len(x) + 1] - found[len(x) + 1 :]) / (2 * SLOPE)

    (value, g), inverse = (yield from around(x)), np.eye(len(x))
    for _ in range(rounds):
        step = -inverse @ g
        if g @ step >= 0:
            inverse, step = np.eye(len(x)), -g
        step *= min(1.0, 1.5 / max(np.linalg.norm(step), 1e-300))
        rate = 1.0
        while rate > 1e-6 and not (yield (x + rate * step)[None])[0] <= value + 1e-4 * rate * (g @ step):
            rate /= 2
        if rate <= 1e-6:
            break
        s = rate * step
        x, before, old = x + s, value, g
        value, g = yield from around(x)
        y = g - old
        if (c := s @ y) > 1e-14:
            turn = np.eye(len(x)) - np.outer(s, y) / c
            inverse = turn @ inverse @ turn.T + np.outer(s, s) / c
        if before - value < 1e-7 or np.abs(g).max() < 1e-6:
            break
    return x


def partial_autocorrelations(w: np.ndarray, lags: int) -> np.ndarray:
    w = w - w.mean()
    c = np.array([w[k:] @ w[: len(w) - k] for k in range(lags + 1)])
    out, a = [], np.empty(0)
    for k in range(1, lags + 1):
        left = c[0] - a @ c[1:k]
        r = (c[k] - a @ c[k - 1 : 0 : -1]) / left if left > 1e-12 * c[0] else 0.0
        out.append(float(np.clip(r, -0.95, 0.95)))
        a = np.r_[a - out[-1] * a[::-1], out[-1]]
    return np.array(out)


def fitted(x: np.ndarray, shape: Shape, start: np.ndarray | None = None) -> Model | None:
    """The model of most likelihood, looked for from `start`, or from the likeliest of a few points; None where the series has
    too few samples for it."""
    return fitted_each([x], shape, start)[0]


def fitted_each(xs: list[np.ndarray], shape: Shape, start: np.ndarray | None = None) -> list[Model | None]:
    """fitted() of many series: each has a search of its own, and the points that all searches ask for are told together."""

    def prepared(x: np.ndarray) -> np.ndarray | None:
        both = differenced(np.column_stack([x, shape.regressors(0, len(x), len(x))]), shape.differences()) if len(x) > shape.d + shape.sd * shape.season else np.empty((0, 1))
        return None if len(both) < shape.free + len(TRENDS[shape.trend]) + 3 else both

    def search(both: np.ndarray) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
        x = start
        if x is None:
            left = both[:, 0] - both[:, 1:] @ np.linalg.lstsq(both[:, 1:], both[:, 0], rcond=None)[0]
            own = np.arctanh(partial_autocorrelations(left, shape.p))
            sign = lambda a, b: np.r_[own if a is None else np.full(shape.p, a), np.full(shape.sp, 0.3), np.full(shape.q, b), np.full(shape.sq, -b / 2)]
            points = np.stack([sign(a, b) for a in ((None, 0.3) if shape.p else (0.0,)) for b in (0.05, 0.5, -0.5)])
            x = points[np.argmin((yield points))]
        return (yield from lowest(x))

    series = {i: both for i, x in enumerate(xs) if (both := prepared(x)) is not None}
    best = dict.fromkeys(series, np.empty(0))
    searches = {i: search(both) for i, both in series.items()} if shape.free else {}
    asked = {i: next(s) for i, s in searches.items()}
    while asked:
        models = iter(likelihoods([series[i] for i, points in asked.items() for _ in points], shape, [u for points in asked.values() for u in points]))
        told, asked = {i: np.array([-next(models).loglik / len(series[i]) for _ in points]) for i, points in asked.items()}, {}
        for i, values in told.items():
            try:
                asked[i] = searches[i].send(values)
            except StopIteration as end:
                best[i] = end.value
    made = dict(zip(series, likelihoods(list(series.values()), shape, list(best.values())), strict=True))
    return [m if (m := made.get(i)) and (not shape.free or math.isfinite(m.loglik)) else None for i in range(len(xs))]


def ahead(x: np.ndarray, model: Model, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The next `steps` values and their standard errors. Those are of the process's errors to come, as if its coefficients were known."""
    shape, n = model.shape, len(x)
    left = x - shape.regressors(0, n, n) @ model.trend
    polynomial = shape.differences()
    ar, ma = polynomials(shape, model.u)
    _, _, state = innovations(differenced(left[:, None], polynomial), ar, ma)
    lags = np.r_[ar, np.zeros(len(state) - len(ar))]
    values = list(left)
    for _ in range(steps):
        values.append(float(state[0, 0]) - sum(c * values[-k] for k, c in enumerate(polynomial) if k and c))
        state = _moved(state, lags)
    whole = -np.convolve(np.r_[1.0, -ar], polynomial)[1:]
    weights = np.zeros(steps)  # what an error does so many steps on
    for k in range(steps):
        past = weights[max(0, k - len(whole)) : k][::-1]
        weights[k] = (1.0 if k == 0 else ma[k - 1] if k <= len(ma) else 0.0) + whole[: len(past)] @ past
    return np.array(values[n:]) + shape.regressors(n, n + steps, n) @ model.trend, np.sqrt(model.variance * np.cumsum(weights**2))
