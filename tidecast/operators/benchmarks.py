"""Benchmarks every run is measured against: persistence, ARIMA, k-means.

ARIMA orders are fitted by the Hannan-Rissanen regressions: a long
autoregression stands in for the shocks, then lags and shocks are regressed
together.  Both steps need one aggregate over the rows, whatever the number of
orders tried and of series, and one-step forecasts are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import log

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.order import join_keys, over_order
from tidecast.operators.stattests import moments, unpack
from tidecast.storage import written_table


def persistence(df: DataFrame, col: str = "y", series_cols: Sequence[str] = ()) -> DataFrame:
    """Predict each value by the one before it."""
    return over_order(
        df, lambda w: {"prediction": F.lag(col, 1).over(w)}, behind=1, series_cols=series_cols
    )


@dataclass(frozen=True)
class Arima:
    """A fitted model; ``ar_coefficients`` go with the lags ``ar``, ``ma_coefficients`` with the shocks ``ma``."""

    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int] | None
    ar: tuple[int, ...]
    ma: tuple[int, ...]
    intercept: float
    ar_coefficients: tuple[float, ...]
    ma_coefficients: tuple[float, ...]
    aic: float


def _difference_lags(d: int, period: int, seasonal_d: int) -> dict[int, float]:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag."""
    poly = np.array([1.0])
    for step in [1] * d + [period] * seasonal_d:
        factor = np.zeros(step + 1)
        factor[0], factor[step] = 1.0, -1.0
        poly = np.convolve(poly, factor)
    return {k: float(c) for k, c in enumerate(poly) if c}


def _linear(intercept: float, terms: Sequence[tuple[float, Column]]) -> Column:
    return reduce(lambda a, t: a + F.lit(float(t[0])) * t[1], terms, F.lit(float(intercept)))


def _regress(n: float, mean: np.ndarray, cov: np.ndarray, pick: Sequence[int], target: int):
    """Least squares with intercept from moments; None when singular."""
    x = cov[np.ix_(pick, pick)]
    try:
        beta = np.linalg.solve(x, cov[pick, target]) if len(pick) else np.zeros(0)
    except np.linalg.LinAlgError:
        return None
    rss = n * (cov[target, target] - beta @ cov[pick, target])
    return mean[target] - beta @ mean[list(pick)], beta, rss


def _per_series(sums: DataFrame, keys: Sequence[str], schema: str, solve: Callable[[list[float]], list | None]) -> DataFrame:
    """One row of ``solve`` for the moments ``v`` of each series; series it gives nothing for drop out."""
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]

    def run(batches):
        for pdf in batches:
            found = [(key, solve(v)) for *key, v in pdf[[*keys, "v"]].itertuples(index=False)]
            yield pd.DataFrame([[*key, *x] for key, x in found if x is not None], columns=names)

    return sums.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema]))


def _with_row(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with the columns of their series' row; of the only row, as constants, if there are no keys."""
    if keys:
        return join_keys(rows, found, keys, "left")
    one = found.first()
    value = lambda f: F.lit(None if one is None else one[f.name]).cast(f.dataType) if one is None or not isinstance(
        one[f.name], list) else F.array(*[F.lit(x) for x in one[f.name]]).cast(f.dataType)
    return rows.withColumns({f.name: value(f) for f in found.schema.fields})


def _long_regression(long: int):
    def solve(v: list[float]) -> list | None:
        if v[0] <= long + 1:
            return None
        n, mean, cov = unpack(v, long + 1)
        found = _regress(n, mean, cov, range(1, long + 1), 0) or (mean[0], np.zeros(long))
        return [float(found[0]), [float(x) for x in found[1]]]
    return solve


def _best_order(ar_all: list[int], ma_all: list[int], orders: Sequence[tuple], period: int):
    """The order with the least AIC from the moments of lags, shocks and the value itself; coefficients not used are 0."""
    width = len(ar_all) + len(ma_all) + 1

    def solve(v: list[float]) -> list | None:
        if v[0] <= width:
            return None
        n, mean, cov = unpack(v, width)
        best = None
        for p, q, sp, sq in orders:
            ar = [i for i, k in enumerate(ar_all) if (k <= p if k != period else sp)]
            ma = [len(ar_all) + i for i, k in enumerate(ma_all) if (k <= q if k != period else sq)]
            fit = _regress(n, mean, cov, [*ar, *ma], width - 1)
            if fit is None or fit[2] <= 0:
                continue
            aic = n * log(fit[2] / n) + 2 * (len(ar) + len(ma) + 1)
            if best is None or aic < best[4] - 1e-9:
                beta = np.zeros(width - 1)
                beta[[*ar, *ma]] = fit[1]
                best = [p, q, sp, sq, float(aic), float(fit[0]), beta[: len(ar_all)].tolist(), beta[len(ar_all):].tolist()]
        return best
    return solve


def panel_arima(
    df: DataFrame,
    train: Column,
    d: int = 0,
    col: str = "y",
    max_p: int = 3,
    max_q: int = 3,
    period: int = 0,
    seasonal_d: int = 0,
    long: int = 12,
    order: tuple[int, int] | None = None,
    series_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """One-step forecasts of every series by its own order with the best AIC, and ``p, q, sp, sq, aic, ...`` of each.

    Fitting goes over moments: one array a series, partial before the shuffle,
    solved where the shuffle put it.  The rows are read twice, for the long
    autoregression and for lags and shocks; only lags in use become columns, so
    a long period costs no more than a short one.  With ``period`` the seasonal
    lag joins both the lags and the shocks.  A series too short to fit, or
    without a solvable order, has no model and null predictions.
    """
    keys, diff = list(series_cols), _difference_lags(d, period, seasonal_d)
    ar_all = [*range(1, max_p + 1), *([period] if period else [])]
    ma_all = [*range(1, max_q + 1), *([period] if period and max_q else [])]
    long = long if ma_all else 0
    extra, seasonal_q = ([0, 1] if period else [0]), ([0, 1] if period and max_q else [0])
    orders = [(*order, 0, 0)] if order else list(product(range(max_p + 1), range(max_q + 1), extra, seasonal_q))
    if keys:
        centred = join_keys(df, df.groupBy(*keys).agg(F.avg(col).alias("_centre")), keys)
    else:
        centred = df.withColumn("_centre", F.lit(df.agg(F.avg(col)).first()[0] or 0.0))
    used = sorted({k + j for k in range(long + 1) for j in diff})
    y = F.col(col) - F.col("_centre")
    rows = over_order(centred, lambda w: {f"_l{k}": F.lag(y, k).over(w) if k else y for k in used}, behind=used[-1], series_cols=keys)
    value = lambda k: _linear(0.0, [(c, F.col(f"_l{k + j}")) for j, c in diff.items()])
    # What centring and differencing took away, from earlier rows only.
    carried = F.col("_centre") + _linear(0.0, [(-c, F.col(f"_l{k}")) for k, c in diff.items() if k])
    if long:
        first = rows.where(train).select(*keys, *[value(k).alias(f"w{k}") for k in range(long + 1)]).dropna(
            subset=[f"w{k}" for k in range(long + 1)])
        fitted = written_table(_per_series(
            moments(first, [f"w{k}" for k in range(long + 1)], keys), keys, "_c double, _phi array<double>", _long_regression(long)), "long-ar")
        rows = _with_row(rows, fitted, keys)
        shock = value(0) - reduce(lambda a, j: a + F.col("_phi")[j] * value(j + 1), range(long), F.col("_c"))
    else:
        shock = F.lit(None).cast("double")
    shocked = written_table(rows.select(*df.columns, value(0).alias("_w"), shock.alias("_e"), carried.alias("_carried")), "shocks")
    reach = max([*ar_all, *ma_all, 1])
    lagged = over_order(shocked, lambda w: {
        **{f"_w{k}": F.lag("_w", k).over(w) for k in ar_all}, **{f"_e{k}": F.lag("_e", k).over(w) for k in ma_all}},
        behind=reach, series_cols=keys)
    names = [*(f"_w{k}" for k in ar_all), *(f"_e{k}" for k in ma_all), "_w"]
    second = lagged.where(train).select(*keys, *names).dropna(subset=names)
    fallback = [] if order else [(1, 1, 0, 0)]
    models = written_table(_per_series(
        moments(second, names, keys), keys,
        "p int, q int, sp int, sq int, aic double, intercept double, ar array<double>, ma array<double>",
        _best_order(ar_all, ma_all, [*orders, *fallback], period)), "arima")
    picked = models.select(*keys, F.col("intercept").alias("_b"), F.col("ar").alias("_ar"), F.col("ma").alias("_ma"))
    joined = _with_row(lagged, picked, keys)
    term = lambda c, x: F.when(c != 0, c * F.col(x)).otherwise(0.0)
    terms = [term(F.col("_ar")[i], f"_w{k}") for i, k in enumerate(ar_all)] + [term(F.col("_ma")[i], f"_e{k}") for i, k in enumerate(ma_all)]
    forecast = reduce(lambda a, t: a + t, terms, F.col("_b")) + F.col("_carried")
    return joined.select(*df.columns, forecast.alias("prediction")), models


def arima(df: DataFrame, train: Column, d: int = 0, col: str = "y", period: int = 0, seasonal_d: int = 0, **options) -> tuple[DataFrame, Arima]:
    """``panel_arima`` of one series, and its model."""
    scored, models = panel_arima(df, train, d, col, period=period, seasonal_d=seasonal_d, **options)
    m = models.first()
    if m is None:
        raise ValueError("too few rows for the ARIMA benchmark, or no order that can be solved")
    ar = tuple(k for k in [*range(1, m["p"] + 1), *([period] if m["sp"] else [])])
    ma = tuple(k for k in [*range(1, m["q"] + 1), *([period] if m["sq"] else [])])
    return scored, Arima((m["p"], d, m["q"]), (m["sp"], seasonal_d, m["sq"], period) if period else None, ar, ma, m["intercept"],
                         tuple(x for x in m["ar"] if x), tuple(x for x in m["ma"] if x), m["aic"])


def kmeans_benchmark(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "y", k: int = 8
) -> tuple[DataFrame, PipelineModel]:
    """Predict the mean training target of the nearest centroid."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_x"),
        KMeans(k=k, seed=42, featuresCol="_x", predictionCol="_cluster"),
    ]
    model = Pipeline(stages=stages).fit(train)
    # k rows, whatever the data.
    means = model.transform(train).groupBy("_cluster").agg(F.avg(target).alias("prediction"))
    scored = model.transform(test).join(F.broadcast(means), "_cluster", "left")
    return scored.drop("_x", "_cluster"), model
