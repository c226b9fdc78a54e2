"""Forecasts of arrival rates: z-scores, models per template, rolling origins, ensembles and their errors.

Series are long frames (template_id, t, rate). Models run in numpy, one template at a time, behind applyInPandas:
templates are dealt over the cluster and a task holds one series. Scores are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WARM_UP = 0.75
LOOK_BACK = 288
HORIZONS = (3, 12, 24, 36, 144, 288, 526, 2016)


def normalized(series: DataFrame, by: Sequence[str] = ("template_id",), value: str = "rate", population: bool = False) -> DataFrame:
    """series with mean, std and z of each group; a constant series has z 0."""
    w = Window.partitionBy(*by)
    std = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    out = series.withColumn("mean", F.avg(value).over(w)).withColumn("std", std)
    return out.withColumn("z", F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0)))


def denormalized(predicted: DataFrame, stats: DataFrame, by: Sequence[str] = ("template_id",)) -> DataFrame:
    """predicted z times the training deviation plus the training mean."""
    return predicted.join(stats, list(by)).withColumn("rate", F.col("z") * F.col("std") + F.col("mean"))


# models: fit(training z, seed) -> predict(recent z, horizon) ---------------------------------------------------------

Fitted = Callable[[np.ndarray, int], np.ndarray]


def _least_squares(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    return np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)


def _lagged(z: np.ndarray, lags: int, ahead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    n = len(z) - lags - ahead + 1
    if n <= 0:
        return np.zeros((0, lags)), np.zeros((0, ahead))
    at = np.arange(n)[:, None]
    return z[at + np.arange(lags)], z[at + lags + np.arange(ahead)]


def _recent(z: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.zeros(max(0, n - len(z))), z[-n:]]) if n else z[:0]


def linear(z: np.ndarray, seed: int = 0, lags: int = 2) -> Fitted:
    """Least squares on the last `lags` values, rolled forward."""
    w = _least_squares(*_lagged(z, lags))[:, 0]

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        window, out = list(_recent(recent, lags)), []
        for _ in range(horizon):
            out.append(float(np.dot(window[-lags:], w[:-1]) + w[-1]))
            window.append(out[-1])
        return np.array(out)

    return predict


def dlinear(z: np.ndarray, seed: int = 0, inputs: int = 24, outputs: int = 12, kernel: int = 25) -> Fitted:
    """Trend (a moving average) and remainder of the last inputs, each mapped linearly onto the next outputs."""

    def parts(x: np.ndarray) -> np.ndarray:
        half = kernel // 2
        padded = np.concatenate([np.repeat(x[:, :1], half, 1), x, np.repeat(x[:, -1:], half, 1)], 1)
        sums = np.cumsum(np.concatenate([np.zeros((len(x), 1)), padded], 1), 1)
        trend = (sums[:, kernel:] - sums[:, :-kernel]) / kernel
        return np.concatenate([trend, x - trend], 1)

    x, y = _lagged(z, inputs, outputs)
    w = _least_squares(parts(x), y, 1e-2) if len(x) else np.zeros((2 * inputs + 1, outputs))

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        window = _recent(recent, inputs)
        out = np.zeros(0)
        while len(out) < horizon:
            step = np.append(parts(window[None, -inputs:])[0], 1) @ w
            out, window = np.concatenate([out, step]), np.concatenate([window, step])
        return out[:horizon]

    return predict


def arima(z: np.ndarray, seed: int = 0, most: int = 5) -> Fitted:
    """Autoregression of the series or its differences; order and differencing with the least AIC."""
    best: tuple[float, int, np.ndarray] | None = None
    for d in (0, 1):
        x = np.diff(z, n=d)
        for p in range(1, most + 1):
            a, y = _lagged(x, p)
            if len(a) <= p + 2:
                continue
            w = _least_squares(a, y)[:, 0]
            error = float(np.mean((np.append(a, np.ones((len(a), 1)), 1) @ w - y[:, 0]) ** 2))
            score = len(a) * np.log(max(error, 1e-12)) + 2 * (p + 1)
            if best is None or score < best[0] - 1e-9:
                best = (score, d, w)
    if best is None:
        return lambda recent, horizon: np.full(horizon, recent[-1] if len(recent) else 0.0)
    _, d, w = best
    p = len(w) - 1

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        window, last, out = list(_recent(np.diff(recent, n=d), p)), float(recent[-1]) if len(recent) else 0.0, []
        for _ in range(horizon):
            step = float(np.dot(window[-p:], w[:-1]) + w[-1])
            window.append(step)
            last = last + step if d else step
            out.append(last)
        return np.array(out)

    return predict


def holt_winters(z: np.ndarray, seed: int = 0, season: int = LOOK_BACK, damping: float = 0.98) -> Fitted:
    """Additive level, damped trend and season by recursion; weights with the least one-step error of a small grid."""
    m = season if len(z) >= 2 * season else 1

    def run(x: np.ndarray, alpha: float, beta: float, gamma: float) -> tuple[float, float, np.ndarray, float]:
        level, trend = float(x[:m].mean()), 0.0
        seasonal = x[:m] - level if m > 1 else np.zeros(1)
        seasonal, error = seasonal.copy(), 0.0
        for t in range(m if m > 1 else 1, len(x)):
            s = seasonal[t % m]
            miss = x[t] - (level + damping * trend + s)
            error += miss * miss
            new = alpha * (x[t] - s) + (1 - alpha) * (level + damping * trend)
            trend = beta * (new - level) + (1 - beta) * damping * trend
            if m > 1:
                seasonal[t % m] = gamma * (x[t] - new) + (1 - gamma) * s
            level = new
        return level, trend, seasonal, error

    if len(z) < 3:
        return lambda recent, horizon: np.full(horizon, recent[-1] if len(recent) else 0.0)
    grid = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.05) for g in ((0.1, 0.3) if m > 1 else (0.0,))]
    alpha, beta, gamma = min(grid, key=lambda p: run(z, *p)[3])
    level, trend, seasonal, _ = run(z, alpha, beta, gamma)
    n = len(z)

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        # the window moves level and trend on from the training state
        lv, tr, start = level, trend, n
        for k, x in enumerate(recent):
            s = seasonal[(start + k) % m]
            new = alpha * (x - s) + (1 - alpha) * (lv + damping * tr)
            tr = beta * (new - lv) + (1 - beta) * damping * tr
            lv = new
        damp = np.cumsum(damping ** np.arange(1, horizon + 1))
        return lv + damp * tr + seasonal[(start + len(recent) + np.arange(horizon)) % m]

    return predict


def _adam(params: list[np.ndarray], grads: Callable[[], tuple[float, list[np.ndarray]]], turns: int, rate: float) -> None:
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, turns + 1):
        _, got = grads()
        norm = np.sqrt(sum(float((g * g).sum()) for g in got))
        for k, g in enumerate(got):
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)


def lstm(z: np.ndarray, seed: int = 0, inputs: int = 24, hidden: int = 20, epochs: int = 30, batch: int = 64) -> Fitted:
    """Two recurrent layers with gates over the last inputs, the next value from the last state; rolled forward."""
    rng = np.random.default_rng(seed)
    sizes = [(1, hidden), (hidden, hidden)]
    params = []
    for i, h in sizes:
        params += [rng.normal(0, 1 / np.sqrt(i + h), (i + h, 4 * h)), np.concatenate([np.ones(h), np.zeros(3 * h)])]
    params += [rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def forward(x: np.ndarray):
        saved, seq = [], [x[:, t : t + 1] for t in range(x.shape[1])]
        for layer, (_, h) in enumerate(sizes):
            w, b = params[2 * layer], params[2 * layer + 1]
            state, cell, steps_, outs = np.zeros((len(x), h)), np.zeros((len(x), h)), [], []
            for value in seq:
                joined = np.concatenate([value, state], 1)
                gates = joined @ w + b
                f, i, o = (sigmoid(gates[:, k * h : (k + 1) * h]) for k in range(3))
                g = np.tanh(gates[:, 3 * h :])
                before, cell = cell, f * cell + i * g
                state = o * np.tanh(cell)
                steps_.append((joined, f, i, o, g, before, cell))
                outs.append(state)
            saved.append(steps_)
            seq = outs
        return (seq[-1] @ params[-2] + params[-1])[:, 0], saved, seq

    x, y = _lagged(z, inputs)
    if len(x):

        def grads():
            at = rng.integers(0, len(x), min(batch, len(x)))
            out, saved, seq = forward(x[at])
            error = (out - y[at, 0]) / len(at)
            got = [np.zeros_like(p) for p in params]
            got[-2], got[-1] = seq[-1].T @ error[:, None], np.array([error.sum()])
            up = [np.zeros((len(at), hidden)) for _ in range(inputs)]
            up[-1] = error[:, None] @ params[-2].T
            for layer in (1, 0):
                size, h = sizes[layer]
                w, down = params[2 * layer], [None] * inputs
                ds, dc = np.zeros((len(at), h)), np.zeros((len(at), h))
                for t in range(inputs - 1, -1, -1):
                    joined, f, i, o, g, before, cell = saved[layer][t]
                    ds = ds + up[t]
                    tc = np.tanh(cell)
                    dc = dc + ds * o * (1 - tc * tc)
                    dg = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), ds * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                    got[2 * layer] += joined.T @ dg
                    got[2 * layer + 1] += dg.sum(0)
                    back = dg @ w.T
                    down[t], ds, dc = back[:, :size], back[:, size:], dc * f
                up = down
            return float((error**2).sum()), got

        _adam(params, grads, epochs * max(1, min(20, len(x) // batch)), 0.01)

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        window = _recent(recent, inputs)
        for _ in range(horizon):
            window = np.append(window, forward(window[None, -inputs:])[0])
        return window[inputs:]

    return predict


def transformer(z: np.ndarray, seed: int = 0, inputs: int = 24, outputs: int = 12, width: int = 16, turns: int = 300, batch: int = 64) -> Fitted:
    """One attention layer over the last inputs (value and place embedded), residual and linear read-out of the next
    outputs; rolled forward in steps of `outputs`."""
    rng = np.random.default_rng(seed)
    place = np.stack([np.sin(np.arange(inputs)[:, None] / 10000 ** (np.arange(width // 2) * 2 / width)), np.cos(np.arange(inputs)[:, None] / 10000 ** (np.arange(width // 2) * 2 / width))], 2).reshape(inputs, width)
    params = [rng.normal(0, 0.5, (1, width)), *(rng.normal(0, 1 / np.sqrt(width), (width, width)) for _ in range(3)), rng.normal(0, 1 / np.sqrt(inputs * width), (inputs * width, outputs)), np.zeros(outputs)]

    def forward(x: np.ndarray):
        e = x[:, :, None] * params[0] + place
        q, k, v = (e @ params[i] for i in (1, 2, 3))
        s = q @ k.transpose(0, 2, 1) / np.sqrt(width)
        a = np.exp(s - s.max(2, keepdims=True))
        a /= a.sum(2, keepdims=True)
        h = e + a @ v
        return h.reshape(len(x), -1) @ params[4] + params[5], (e, q, k, v, a, h)

    x, y = _lagged(z, inputs, outputs)
    if len(x):

        def grads():
            at = rng.integers(0, len(x), min(batch, len(x)))
            out, (e, q, k, v, a, h) = forward(x[at])
            error = (out - y[at]) / (len(at) * outputs)
            got = [np.zeros_like(p) for p in params]
            got[4], got[5] = h.reshape(len(at), -1).T @ error, error.sum(0)
            dh = (error @ params[4].T).reshape(h.shape)
            da, dv = dh @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dh
            ds = a * (da - (da * a).sum(2, keepdims=True)) / np.sqrt(width)
            de = dh.copy()
            for i, d in ((1, ds @ k), (2, ds.transpose(0, 2, 1) @ q), (3, dv)):
                got[i] = np.einsum("bnw,bnv->wv", e, d)
                de += d @ params[i].T
            got[0] = np.einsum("bn,bnw->w", x[at], de)[None, :]
            return float((error**2).sum()), got

        _adam(params, grads, turns, 0.01)

    def predict(recent: np.ndarray, horizon: int) -> np.ndarray:
        window = _recent(recent, inputs)
        while len(window) < inputs + horizon:
            window = np.concatenate([window, forward(window[None, -inputs:])[0][0]])
        return window[inputs : inputs + horizon]

    return predict


MODELS: dict[str, Callable[..., Fitted]] = {"linear": linear, "dlinear": dlinear, "arima": arima, "holt_winters": holt_winters, "lstm": lstm, "transformer": transformer}


def rolling_forecast(series: DataFrame, methods: Mapping[str, float], horizon: int, warm_up: float = WARM_UP, look_back: int = LOOK_BACK, tail: int = LOOK_BACK, seed: int = 0) -> DataFrame:
    """(template_id, origin, t, rate, z): forecasts from rolling origins, as the weighted sum of the methods.

    Each template is trained on the first `warm_up` share of its rows (ordered by t), normalised by that part's mean
    and deviation, which also turn forecasts back. Origins start there and advance by the horizon while more than
    `tail` rows remain; a forecast sees the `look_back` rows before its origin.
    """
    chosen = {name: MODELS[name] for name in methods}
    weights = dict(methods)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y, t = pdf["rate"].to_numpy(float), pdf["t"].to_numpy()
        split = int(len(y) * warm_up)
        mean = float(y[:split].mean()) if split else 0.0
        std = float(y[:split].std(ddof=1)) if split > 1 else 0.0
        z = (y - mean) / std if std > 0 else np.zeros(len(y))
        fitted = {name: make(z[:split], seed) for name, make in chosen.items()}
        rows, origin = [], split
        while origin < len(y) - tail:
            window = z[max(0, origin - look_back) : origin]
            ahead = sum(weights[name] * predict(window, horizon) for name, predict in fitted.items())
            for k in range(min(horizon, len(y) - origin)):
                rows.append((pdf["template_id"].iloc[0], int(origin), int(t[origin + k]), float(ahead[k] * std + mean), float(ahead[k])))
            origin += horizon
        return pd.DataFrame(rows, columns=["template_id", "origin", "t", "rate", "z"])

    return series.select(F.col("template_id").cast("long"), F.col("t").cast("long"), F.col("rate").cast("double")).groupBy("template_id").applyInPandas(run, "template_id long, origin long, t long, rate double, z double")


def score(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """(origin, mae, mse, rmse): means over templates of each template's mean error; rmse is the root of the mean mse."""
    joined = predicted.join(actual.withColumnRenamed("rate", "actual"), ["template_id", "t"])
    gap = F.col("rate") - F.col("actual")
    per = joined.groupBy("origin", "template_id").agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))
    return per.groupBy("origin").agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"))


def mean_score(scores: DataFrame, first: int = 13) -> DataFrame:
    """Means of mae, mse and rmse over the first origins."""
    return scores.orderBy("origin").limit(first).agg(F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.avg("rmse").alias("rmse"))


def top_and_others(series: DataFrame, top: int = 10) -> DataFrame:
    """(template, mean_rate) of the busiest templates, and the rest summed as 'others'."""
    means = series.groupBy("template_id").agg(F.avg("rate").alias("mean_rate"))
    best = means.orderBy(F.col("mean_rate").desc(), "template_id").limit(top)
    rest = means.join(best.select("template_id"), "template_id", "left_anti").agg(F.coalesce(F.sum("mean_rate"), F.lit(0.0)).alias("mean_rate"))
    return best.select(F.col("template_id").cast("string").alias("template"), "mean_rate").unionByName(rest.select(F.lit("others").alias("template"), "mean_rate"))


def real_and_forecast_means(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """(template_id, real_mean, forecast_mean) over the forecast steps."""
    joined = predicted.join(actual.withColumnRenamed("rate", "actual"), ["template_id", "t"])
    return joined.groupBy("template_id").agg(F.avg("actual").alias("real_mean"), F.avg("rate").alias("forecast_mean"))


def horizon_sweep(series: DataFrame, methods: Mapping[str, float], horizons: Sequence[int] = HORIZONS, **settings) -> DataFrame:
    """(horizon, mae, mse, rmse) for each horizon."""
    out = None
    for h in horizons:
        got = mean_score(score(series, rolling_forecast(series, methods, h, **settings))).withColumn("horizon", F.lit(h))
        out = got if out is None else out.unionByName(got)
    return out.select("horizon", "mae", "mse", "rmse")
