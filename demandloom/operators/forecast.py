"""Per-product forecasts for all products at once, and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import name_col, to_number
from demandloom.operators.accuracy import error_metrics
from demandloom.operators.series import last_n
from demandloom.session import checkpoint

# Order limits of the automatic search and the least history.
MAX_P, MAX_Q, MAX_D = 5, 5, 3
MIN_POINTS = 3
KPSS_CRITICAL = 0.463
Z_95 = 1.959963984540054
#: Most rounds of the exact fit, and the relative gain that ends it.
EXACT_ROUNDS, EXACT_GAIN = 20, 1e-9

FORECAST_SCHEMA = "step int, forecast double, lower double, upper double, status string, method string, data_points int"


def forecast_naive(
    series: DataFrame, horizon: int, by: Sequence[str] = ("product_id",), order: str = "period_end", value: str = "quantity"
) -> DataFrame:
    """The last value of each series, repeated."""
    last = series.groupBy(*by).agg(F.max_by(name_col(value).cast("double"), name_col(order)).alias("forecast"))
    return last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")


def kpss_statistic(y: np.ndarray) -> float:
    """Level-stationarity statistic with a Bartlett long-run variance."""
    n = len(y)
    e = y - y.mean()
    lags = int(np.trunc(3 * np.sqrt(n) / 13))
    variance = e @ e / n
    for k in range(1, lags + 1):
        variance += 2 / n * (1 - k / (lags + 1)) * (e[k:] @ e[:-k])
    return float(np.sum(np.cumsum(e) ** 2) / (n**2 * variance)) if variance > 0 else 0.0


def choose_difference(y: np.ndarray) -> int:
    d = 0
    while d < MAX_D and len(y) > MIN_POINTS and np.ptp(y) > 0 and kpss_statistic(y) > KPSS_CRITICAL:
        y = np.diff(y)
        d += 1
    return d


def _lagged(x: np.ndarray, count: int, start: int) -> list[np.ndarray]:
    return [x[start - k : len(x) - k] for k in range(1, count + 1)]


def _inside(c: np.ndarray) -> bool:
    """All roots of x^k - c1 x^(k-1) - ... - ck are inside the unit circle."""
    if len(c) == 0:
        return True
    if len(c) == 1:
        return abs(c[0]) < 0.999
    if len(c) == 2:
        return abs(c[1]) < 0.998 and abs(c[0]) < 0.999 - c[1]
    return np.max(np.abs(np.roots(np.concatenate(([1.0], -c))))) < 0.999


def fit_arma(w: np.ndarray, p: int, q: int, shocks: np.ndarray, start: int):
    """Hannan-Rissanen: regress on own lags and lagged shocks of a long autoregression, from ``start`` on."""
    target = w[start:]
    columns = [np.ones(len(target)), *_lagged(w, p, start), *_lagged(shocks, q, start)]
    design = np.column_stack(columns)
    if len(target) <= design.shape[1] + 1:
        return None
    beta, *_ = np.linalg.lstsq(design, target, rcond=None)
    phi, theta = beta[1 : p + 1], beta[p + 1 :]
    if not (_inside(phi) and _inside(-theta)):
        return None
    residuals = target - design @ beta
    n, k = len(target), design.shape[1] + 1
    sigma2 = residuals @ residuals / n
    if sigma2 <= 0 or n - k - 1 <= 0:
        return None
    score = np.log(sigma2) + (2 * k + 2 * k * (k + 1) / (n - k - 1)) / n
    return score, beta[0], phi, theta, sigma2, residuals


def order_limits(n: int, long_order: int) -> tuple[int, int]:
    """Highest p and q whose models leave enough of ``n`` points to be compared on one sample."""
    for limit in range(max(MAX_P, MAX_Q), 0, -1):
        p, q = min(limit, MAX_P), min(limit, MAX_Q)
        if n - max(p, long_order + q) >= p + q + 4:
            return p, q
    return (1, 0) if n >= 6 else (0, 0)


def search_orders(w: np.ndarray, shocks: np.ndarray, long_order: int):
    """(fit, p, q) of the lowest criterion, walking from the best small model to better neighbours.

    All models are scored on the same points, those that the largest one leaves; the one chosen is
    then fitted to all the points it can use.
    """
    tried: dict[tuple[int, int], object] = {}
    max_p, max_q = order_limits(len(w), long_order)
    common = max(max_p, long_order + max_q if max_q else 0)

    def score(order):
        if order not in tried:
            tried[order] = fit_arma(w, *order, shocks, common)
        return tried[order][0] if tried[order] is not None else np.inf

    def fitted(p, q):
        if tried[p, q] is None:
            return None
        fit = fit_arma(w, p, q, shocks, max(p, long_order + q if q else 0))
        return (fit or tried[p, q], p, q)

    here = min([o for o in [(0, 0), (1, 0), (0, 1), (2, 2)] if o[0] <= max_p and o[1] <= max_q], key=score)
    while True:
        p, q = here
        near = [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min([o for o in near if 0 <= o[0] <= max_p and 0 <= o[1] <= max_q], key=score)
        if score(best) >= score(here):
            return fitted(*here)
        here = best


def filtered(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kalman filter of a stationary ARMA series of mean 0: innovations, their variances (in units of the shocks'), state after the end."""
    r = max(len(phi), len(theta) + 1)
    move = np.eye(r, k=1)
    move[: len(phi), 0] = phi
    shock = np.zeros(r)
    shock[0], shock[1 : len(theta) + 1] = 1.0, theta
    noise = np.outer(shock, shock)
    cover = np.linalg.solve(np.eye(r * r) - np.kron(move, move), noise.ravel()).reshape(r, r)
    state, innovations, variances = np.zeros(r), np.empty(len(w)), np.empty(len(w))
    settled = False
    for t, value in enumerate(w):
        if not settled:
            variance = cover[0, 0]
            gain = cover[:, 0] / variance
            cover = move @ (cover - np.outer(gain, cover[0])) @ move.T + noise
            settled = abs(variance - 1) < 1e-12 and abs(cover[0, 0] - 1) < 1e-12
        innovations[t], variances[t] = value - state[0], variance
        state = move @ (state + gain * innovations[t])
    return innovations, variances, state


def exact_likelihood(w: np.ndarray, mean: float, phi: np.ndarray, theta: np.ndarray) -> float:
    """Log-likelihood of a Gaussian ARMA series, with the shocks' variance that makes it largest."""
    innovations, variances, _ = filtered(w - mean, phi, theta)
    n = len(w)
    sigma2 = np.sum(innovations**2 / variances) / n
    return float(-0.5 * (n * (np.log(2 * np.pi * sigma2) + 1) + np.log(variances).sum()))


def fit_exact(w: np.ndarray, x: np.ndarray, mean: float, phi: np.ndarray, theta: np.ndarray):
    """(mean, phi, theta, weights of x, sigma2, state after the end) of the largest exact likelihood near a start.

    The likelihood grows as the sum of squares of the scaled innovations falls, so the steps are
    those of damped least squares. Only steps that gain are taken, so the result is never less
    likely than the start; None if the start is no stationary and invertible model.
    """
    p, q = len(phi), len(theta)
    at = np.r_[mean, phi, theta, np.zeros(x.shape[1])]
    unit = np.r_[np.std(w) or 1.0, np.ones(p + q), [(np.std(w) or 1.0) / (np.std(c) or 1.0) for c in x.T]]

    def errors(at):
        if not (_inside(at[1 : p + 1]) and _inside(-at[p + 1 : p + q + 1])):
            return None
        innovations, variances, _ = filtered(w - at[0] - x @ at[p + q + 1 :], at[1 : p + 1], at[p + 1 : p + q + 1])
        return innovations / np.sqrt(variances) * np.exp(np.log(variances).mean() / 2)

    here, damping = errors(at), 1e-3
    if here is None:
        return None
    for _ in range(EXACT_ROUNDS):
        slopes = np.zeros((len(w), len(at)))
        for i in range(len(at)):
            for step in (1e-6, -1e-6):
                moved = at.copy()
                moved[i] += step * unit[i]
                there = errors(moved)
                if there is not None:
                    slopes[:, i] = (there - here) / step
                    break
        square, slope, loss = slopes.T @ slopes, slopes.T @ here, here @ here
        gained = 0.0
        while damping < 1e8 and gained <= 0:
            step, *_ = np.linalg.lstsq(square + damping * np.diag(np.diag(square)), -slope, rcond=None)
            there = errors(at + step * unit)
            if there is not None and there @ there < loss:
                gained = loss - there @ there
                at, here, damping = at + step * unit, there, damping / 10
            else:
                damping *= 10
        if gained <= EXACT_GAIN * loss:
            break
    phi, theta, weights = at[1 : p + 1], at[p + 1 : p + q + 1], at[p + q + 1 :]
    innovations, variances, state = filtered(w - at[0] - x @ weights, phi, theta)
    return at[0], phi, theta, weights, float(np.mean(innovations**2 / variances)), state


def arima_path(y: np.ndarray, horizon: int, exact: bool = False, x: np.ndarray | None = None, x_new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """(point forecasts, standard errors, method).

    The shorter the series, the smaller the models that are tried, down to the mean of the
    differences. A series without variation repeats its last value. ``exact`` refines the chosen
    model's least-squares fit by the exact likelihood, jointly with weights of the columns ``x``
    if given, whose coming values are ``x_new``.
    """
    d = choose_difference(y)
    w = np.diff(y, d) if d else y
    best = None
    if d or np.ptp(w) > 0:
        long_order = max(1, min(int(10 * np.log10(len(w))), len(w) // 4))
        design = np.column_stack([np.ones(len(w) - long_order), *_lagged(w, long_order, long_order)])
        beta, *_ = np.linalg.lstsq(design, w[long_order:], rcond=None)
        shocks = np.full(len(w), np.nan)
        shocks[long_order:] = w[long_order:] - design @ beta
        best = search_orders(w, shocks, long_order)
        if best is None:  # too few points to compare models
            best = (0.0, w.mean(), np.zeros(0), np.zeros(0), float(np.var(w)), w - w.mean()), 0, 0
    if best is None:
        steps = np.sqrt(np.arange(1, horizon + 1))
        spread = np.std(np.diff(y)) if len(y) > 1 else 0.0
        return np.repeat(y[-1], horizon), spread * steps, "naive"
    (_, constant, phi, theta, sigma2, residuals), p, q = best
    refined = None
    if exact:
        x = np.zeros((len(y), 0)) if x is None else x
        refined = fit_exact(w, np.diff(x, d, axis=0) if d else x, constant / (1 - phi.sum()), phi, theta)
    if refined is not None:
        mean, phi, theta, weights, sigma2, state = refined
        y = y - x @ weights
        path = np.empty(horizon)
        for step in range(horizon):
            path[step] = mean + state[0]
            ahead = np.r_[state[1:], 0.0]
            ahead[:p] += phi * state[0]
            state = ahead
    else:
        history, errors = list(w), list(residuals)
        for _ in range(horizon):
            ar = sum(phi[i] * history[-1 - i] for i in range(p))
            ma = sum(theta[i] * errors[-1 - i] for i in range(min(q, len(errors))))
            history.append(constant + ar + ma)
            errors.append(0.0)
        path = np.array(history[len(w) :])
    psi = np.zeros(horizon)
    psi[0] = 1.0
    for j in range(1, horizon):
        psi[j] = (theta[j - 1] if j <= q else 0.0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(p, j)))
    for level in range(d - 1, -1, -1):
        path = np.diff(y, level)[-1] + np.cumsum(path) if level else y[-1] + np.cumsum(path)
        psi = np.cumsum(psi)
    if refined is not None and x_new is not None:
        path = path + x_new @ weights
    return path, np.sqrt(sigma2 * np.cumsum(psi**2)), f"arima({p},{d},{q})"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys over many tasks: fitting costs far more than its few input bytes, by which adaptive
    execution would put all keys into one task."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def _series_arrays(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with its series as arrays in time order.

    The input is bucketed, so an array is no longer than the number of buckets. Many keys then share
    one Arrow batch, which spares the cost of a Python frame per key.
    """
    cells = F.struct(name_col(order).alias("_order"), *[name_col(c).cast("double").alias(c) for c in columns])
    packed = (
        spread(df.filter(name_col(columns[0]).isNotNull()), by)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(cells)).alias("s"))
    )
    return packed.select(*by, *[F.col("s").getField(c).alias(c) for c in columns])


def _result_schema(series: DataFrame, by: Sequence[str]) -> T.StructType:
    keys = T.StructType([series.schema[c] for c in by])
    return T.StructType(keys.fields + T.StructType.fromDDL(FORECAST_SCHEMA).fields)


def _result_rows(keys: tuple, y: np.ndarray, forecast) -> list[tuple]:
    """Output rows of one key; ``forecast`` is (path, error, method), None for too little data."""
    if forecast is None:
        return [(*keys, 0, None, None, None, "no_data", None, len(y))]
    path, error, method = forecast
    return [
        (*keys, step, float(f), float(f - Z_95 * e), float(f + Z_95 * e), "success", method, len(y))
        for step, (f, e) in enumerate(zip(path, error), 1)
    ]


def forecast_arima(
    series: DataFrame, horizon: int, by: Sequence[str] = ("product_id",), order: str = "bucket", value: str = "quantity", exact: bool = False
) -> DataFrame:
    """Automatic ARIMA per key with 95 % intervals; fewer than 3 points give one no_data row.

    The models are chosen and fitted by least squares; ``exact`` then refines the chosen one by its
    exact likelihood, at many times the cost.
    """
    names = list(by)
    schema = _result_schema(series, names)

    def run(batches):
        for pdf in batches:
            out = []
            for *keys, values in pdf.itertuples(index=False, name=None):
                y = np.asarray(values, dtype=float)
                out += _result_rows(tuple(keys), y, arima_path(y, horizon, exact) if len(y) >= MIN_POINTS else None)
            yield pd.DataFrame(out, columns=schema.names)

    return _series_arrays(series, names, order, [value]).mapInPandas(run, schema=schema)


def forecast_arimax(
    series: DataFrame,
    future: DataFrame,
    exogenous: Sequence[str],
    by: Sequence[str] = ("product_id",),
    order: str = "period_end",
    value: str = "quantity",
    step: str = "period",
    exact: bool = False,
) -> DataFrame:
    """Regression on exogenous columns with ARIMA errors; ``future`` holds their coming values.

    ``exact`` fits the regression and the errors' model together by their exact likelihood.
    """
    names, xs = list(by), list(exogenous)
    schema = _result_schema(series, names)
    past = _series_arrays(series.na.drop(subset=[value, *xs]), names, order, [value, *xs])
    ahead = _series_arrays(future, names, step, xs).withColumnsRenamed({c: f"_next_{c}" for c in xs})

    def fit(y, x, x_new):
        centre = x.mean(axis=0)
        beta, *_ = np.linalg.lstsq(x - centre, y - y.mean(), rcond=None)
        path, error, method = arima_path(y - (x - centre) @ beta, len(x_new), exact, x - centre, x_new - centre)
        return path + (x_new - centre) @ beta, error, method.replace("arima", "arimax")

    def run(batches):
        k = len(names)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                y = np.asarray(row[k], dtype=float)
                usable = len(y) >= MIN_POINTS and row[-1] is not None
                x, x_new = (np.column_stack([np.asarray(c, dtype=float) for c in part]) if usable else None for part in (row[k + 1 : k + 1 + len(xs)], row[k + 1 + len(xs) :]))
                out += _result_rows(row[:k], y, fit(y, x, x_new) if usable else None)
            yield pd.DataFrame(out, columns=schema.names)

    return past.join(ahead, on=names, how="left").mapInPandas(run, schema=schema)


def clean_forecast(df: DataFrame, horizon: int, column: str = "forecast") -> DataFrame:
    """Clamp negatives to 0, pad with the last value or cut to ``horizon``.

    ``forecast_status`` is missing for an empty list and invalid when an element is no number; the
    list is NULL then.
    """
    dtype = df.schema[column].dataType.elementType
    raw = name_col(column)
    if isinstance(dtype, T.StringType):
        numbers = F.transform(raw, to_number)
    else:
        numbers = F.transform(raw, lambda v: v.cast("double"))
    clean = F.transform(numbers, lambda v: F.greatest(v, F.lit(0.0)))
    status = (
        F.when(raw.isNull() | (F.size(raw) == 0), "missing")
        .when(F.exists(numbers, lambda v: v.isNull()), "invalid")
        .otherwise("ok")
    )
    padded = F.slice(F.concat(clean, F.array_repeat(F.element_at(clean, -1), horizon)), 1, horizon)
    staged = df.withColumn("forecast_status", status)
    # the padding must not look at an empty list
    return staged.withColumn(column, F.when(F.col("forecast_status") == "ok", padded))


def hold_out(series: DataFrame, horizon: int, by: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(all but the last ``horizon`` buckets per key, those buckets with ``step``)."""
    test = last_n(series, horizon, by, order).withColumnRenamed("position", "step")
    cut = test.groupBy(*by).agg(F.min(order).alias("_cut"))
    train = series.join(cut, on=list(by)).filter(name_col(order) < F.col("_cut")).drop("_cut")
    return train, test


def backtest(
    series: DataFrame,
    horizon: int,
    by: Sequence[str] = ("product_id",),
    order: str = "bucket",
    value: str = "quantity",
    extra: Mapping[str, DataFrame] | None = None,
    more: Mapping[str, Callable[[DataFrame, int, list[str], str, str], DataFrame]] | None = None,
) -> DataFrame:
    """Errors of each model on the last ``horizon`` buckets per key, and the best model.

    ``extra`` adds forecasts made elsewhere, as (keys, step, forecast); ``more`` adds models, which get
    the training buckets, the horizon, the keys and the names of order and value, like
    ``learn.forecast_trees``. The series is kept in a table, since the split and every model start
    from it.
    """
    keys = list(by)
    train, test = hold_out(checkpoint(series), horizon, keys, order)
    models = {
        "naive": forecast_naive(train, horizon, keys, order, value),
        "arima": forecast_arima(train, horizon, keys, order, value).filter("status = 'success'"),
        **(extra or {}),
        **{name: model(train, horizon, keys, order, value) for name, model in (more or {}).items()},
    }
    forecasts = None
    for name, frame in models.items():
        part = frame.select(*keys, "step", "forecast", F.lit(name).alias("model"))
        forecasts = part if forecasts is None else forecasts.unionByName(part)
    scored = test.select(*keys, "step", name_col(value).alias("actual")).join(forecasts, on=[*keys, "step"])
    errors = checkpoint(error_metrics(scored, "actual", "forecast", [*keys, "model"]))
    best = errors.groupBy(*keys).agg(F.min(F.struct("mae", "model")).alias("b"))
    return errors.join(best, on=keys).select(
        *keys, "model", "mae", "mse", "mape", "n", (F.col("model") == F.col("b.model")).alias("is_best")
    )
