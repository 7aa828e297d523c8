"""Autocorrelation, partial autocorrelation and tests of a series.

Lag columns come from split windows, moments from one aggregate with partial
sums.  What is solved in Python is one small matrix per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.stats import pearson
from tidecast.functions.tails import chi2_tail, dickey_fuller_p, f_tail
from tidecast.operators.order import STRETCH, join_keys, over_order, with_halo, without_nulls
from tidecast.storage import written_table

SMALL_SERIES = 50
SIGNIFICANT_ACF = 0.1
USEFUL_XCORR = 0.15


def acf(df: DataFrame, col: str, max_lag: int = 24, series_cols: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation at lags 1..max_lag, at most a quarter of the series.

    Plain sums of products are corrected for the mean of each series after the
    aggregate, so no mean has to be joined back.  A common shift keeps them
    well scaled.
    """
    keys = list(series_cols)
    lags = range(1, max_lag + 1)
    df = without_nulls(df, col, keys)
    shift = F.lit(df.agg(F.avg(col)).first()[0] or 0.0)
    lagged = over_order(
        df.select(*keys, "t_idx", (F.col(col) - shift).alias("y")),
        lambda w: {f"y{k}": F.lag("y", k).over(w) for k in lags},
        behind=max_lag, series_cols=keys,
    )
    sums = [F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")]
    for k in lags:
        past = F.col(f"y{k}")
        sums += [
            F.sum(F.col("y") * past).alias(f"p{k}"),
            F.sum(F.when(past.isNotNull(), F.col("y") + past)).alias(f"t{k}"),
        ]
    wide = lagged.groupBy(*keys).agg(*sums).withColumn("m", F.try_divide("s", "n"))
    m, spread = F.col("m"), F.col("ss") - F.col("s") * F.col("m")
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("lag"),
            F.try_divide(F.col(f"p{k}") - m * F.col(f"t{k}") + (F.col("n") - k) * m * m, spread).alias("acf"),
        )
        for k in lags
    ])
    most = F.greatest(F.floor(F.col("n") / 4), F.lit(1))
    return wide.select(*keys, "n", F.inline(rows)).where(F.col("lag") <= most)


def significant_lags(curve: DataFrame) -> DataFrame:
    return curve.where(F.col("acf") > SIGNIFICANT_ACF)


def cross_correlation(
    df: DataFrame, features: Sequence[str], target: str, max_lag: int = 3, series_cols: Sequence[str] = ()
) -> DataFrame:
    """Correlation of the target with each feature 0..max_lag steps earlier."""
    keys = list(series_cols)
    lagged = over_order(
        df.select(*keys, "t_idx", target, *features),
        lambda w: {f"{f}|{k}": F.lag(f, k).over(w) for f in features for k in range(1, max_lag + 1)},
        behind=max_lag, series_cols=keys,
    )
    pairs = [(f, k) for f in features for k in range(max_lag + 1)]
    wide = lagged.groupBy(*keys).agg(*[
        pearson(target, f if k == 0 else f"{f}|{k}").alias(f"r{i}") for i, (f, k) in enumerate(pairs)
    ])
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"r{i}").alias("xcorr"))
        for i, (f, k) in enumerate(pairs)
    ])
    flat = wide.select(*keys, F.inline(rows))
    return flat.withColumn("useful", F.coalesce(F.abs("xcorr") > USEFUL_XCORR, F.lit(False)))


def pacf(curve: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the ACF of each series."""
    keys = list(series_cols)

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        rho = pdf["acf"].to_numpy()
        out, phi, spread = [], np.zeros(0), 1.0
        for k in range(len(rho)):
            last = (rho[k] - phi @ rho[:k][::-1]) / spread if spread > 0 else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            spread *= 1 - last**2
            out.append(last)
        return pdf.assign(pacf=out)

    types = {f.name: f.dataType.simpleString() for f in curve.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in curve.columns), "pacf double"])
    return curve.groupBy(*(keys or [F.lit(0).alias("_one")])).applyInPandas(levinson, schema)


def ljung_box(curve: DataFrame, lags: int = 10, series_cols: Sequence[str] = ()) -> DataFrame:
    """Q statistic and p-value over the first ``lags`` autocorrelations."""
    term = F.pow("acf", F.lit(2)) / (F.col("n") - F.col("lag"))
    stats = curve.where(F.col("lag") <= lags).groupBy(*series_cols).agg(
        (F.first("n") * (F.first("n") + 2) * F.sum(term)).alias("q_stat"),
        F.count("acf").alias("lags"),
    )

    @F.pandas_udf("double")
    def p_value(q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else chi2_tail(x, k) for x, k in zip(q, n)], dtype="float64")

    tested = stats.withColumn("p_value", p_value("q_stat", "lags"))
    return tested.withColumn("white_noise", F.col("p_value") >= 0.05)


def moments(df: DataFrame, cols: Sequence[str], series_cols: Sequence[str] = ()) -> DataFrame:
    """Sums and sums of products of columns, one array ``v`` per series, for ``unpack``.

    Expects rows without nulls, shifted so that means are not far from zero.
    Each batch of rows becomes one small matrix product; the shuffle carries
    those products only.
    """
    keys, width = list(series_cols), len(cols)
    upper = np.triu_indices(width)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "v array<double>"])

    def products(x: np.ndarray) -> list[float]:
        return [float(len(x)), *x.sum(axis=0).tolist(), *(x.T @ x)[upper].tolist()]

    def partial(batches):
        for pdf in batches:
            if not keys:
                yield pd.DataFrame({"v": [products(pdf[cols].to_numpy(dtype=float))]})
                continue
            rows = [
                [*key, products(part[cols].to_numpy(dtype=float))]
                for key, part in pdf.groupby(keys, sort=False, dropna=False)
            ]
            yield pd.DataFrame(rows, columns=[*keys, "v"])

    cols = list(cols)
    return _summed(df.select(*keys, *cols).mapInPandas(partial, schema), keys)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of the arrays ``v`` of each series."""
    summed = parts.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    # A fixed number of entries per series.
    entries = F.array_sort(F.collect_list(F.struct("i", "x")))
    return summed.groupBy(*keys).agg(F.transform(entries, lambda e: e["x"]).alias("v"))


def unpack(v: Sequence[float], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population covariance matrix from the sums of ``moments``."""
    n, s = v[0], np.array(v[1:width + 1])
    square = np.zeros((width, width))
    square[np.triu_indices(width)] = v[width + 1:]
    square += np.triu(square, 1).T
    mean = s / n
    return int(n), mean, square / n - np.outer(mean, mean)


def _lagged_sums(rows: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """One row per series: sums ``v`` of products of its lags, and its first and last ``reach`` values.

    Over the rows that have ``reach`` rows before them, ``v`` holds their number,
    the sums of the level (the value one row before) and of its square, of the
    level times each step and of the last step times each step, the nearest
    first.  Products of two earlier steps are the same sums some rows before, so
    the ends of the series are all that they need besides, see ``_square``.
    """
    size = max(STRETCH, 10 * reach)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "at bigint", "v array<double>", "head array<double>", "tail array<double>"])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for key, part in pdf.sort_values("t_idx").groupby(keys, sort=False, dropna=False) if keys else [((), pdf.sort_values("t_idx"))]:
            y = part["y"].to_numpy(dtype=float)
            if len(y) <= reach:  # a halo only, or too short a series
                continue
            level, steps = y[reach - 1: -1], np.diff(y)
            with_level = np.correlate(steps, level, "valid")[::-1]
            with_last = np.correlate(steps, steps[reach - 1:], "valid")[::-1]
            v = [float(len(level)), level.sum(), level @ level, *with_level, *with_last]
            found.append([*key, part["_stretch"].iloc[0], v, y[:reach].tolist(), y[-reach:].tolist()])
        return pd.DataFrame(found, columns=[*keys, "at", "v", "head", "tail"], dtype=object)

    # Short series share a call, some STRETCH rows together.
    calls = F.pmod(F.xxhash64(*keys), F.lit(rows.count() // STRETCH + 1)) if keys else F.lit(0)
    spread = with_halo(rows, size, reach).groupBy(calls.alias("_call"), "_stretch")
    parts = written_table(spread.applyInPandas(sums, schema), "lagged-sums")
    ends = parts.groupBy(*keys).agg(F.min_by("head", "at").alias("head"), F.max_by("tail", "at").alias("tail"))
    summed = _summed(parts, keys)
    return join_keys(summed, ends, keys) if keys else summed.crossJoin(ends)  # one row each


def _square(v: Sequence[float], head: Sequence[float], tail: Sequence[float]) -> tuple[int, np.ndarray]:
    """Count and population covariances of the level, the steps from one row back on, and the last step."""
    v, head, tail = np.array(v), np.array(head), np.array(tail)
    reach, n = len(head), v[0]
    with_level, with_last = v[3: 3 + reach], v[3 + reach:]
    before, after = np.diff(head)[::-1], np.diff(tail)[::-1]  # steps that come in and go out, the latest first
    steps = np.empty((reach, reach))
    steps[0] = steps[:, 0] = with_last
    for i in range(reach - 1):
        steps[i + 1, 1:] = steps[i, :-1] + before[i] * before - after[i] * after
    total = np.concatenate([[v[1]], (tail - head)[::-1]])
    square = np.empty((reach + 1, reach + 1))
    square[0, 0], square[0, 1:], square[1:, 0], square[1:, 1:] = v[2], with_level, with_level, steps
    mean = total / n
    order = [0, *range(2, reach + 1), 1]
    return int(n), (square / n - np.outer(mean, mean))[np.ix_(order, order)]


def adf_lags(n: int) -> int:
    """Schwert's rule, for series of at least a few rows."""
    return int(max(min(floor(12 * (n / 100) ** 0.25), n // 2 - 3), 0))


def adf(df: DataFrame, col: str, max_lag: int | None = None, series_cols: Sequence[str] = ()) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; lag order by AIC.

    Orders up to ``max_lag`` are tried; if it is not given, up to Schwert's
    rule for the longest series.
    One pass over stretches yields a few sums per lag; every lag order is solved from them.
    Series under 50 rows get nulls instead of a test.
    """
    keys = list(series_cols)
    df = without_nulls(df, col, keys)
    centre = df.agg(F.avg(col)).first()[0] or 0.0
    rows = df.select(*keys, "t_idx", (F.col(col) - F.lit(centre)).alias("y"))
    if max_lag is None:
        max_lag = adf_lags((rows.agg(F.max("t_idx")).first()[0] or 0) + 1)
    reach = max_lag + 1

    sums = _lagged_sums(rows, reach, keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([
        *(f"`{k}` {types[k]}" for k in keys),
        "adf_stat double, p_value double, used_lag int, n_obs bigint, stationary boolean",
    ])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, cov = _square(row.v, row.head, row.tail)
                best = None
                if n + reach >= SMALL_SERIES:
                    c = cov * n
                    for p in range(max_lag + 1):
                        x, xy = c[: p + 1, : p + 1], c[: p + 1, -1]
                        try:
                            inverse = np.linalg.inv(x)
                        except np.linalg.LinAlgError:
                            continue
                        beta = inverse @ xy
                        rss = c[-1, -1] - beta @ xy
                        if rss <= 0:
                            continue
                        score = n * log(rss / n) + 2 * (p + 2)
                        error = sqrt(rss / (n - p - 2) * inverse[0, 0])
                        if best is None or score < best[0]:
                            best = (score, beta[0] / error, p)
                own = [getattr(row, k) for k in keys]
                if best is None:
                    out.append([*own, None, None, None, n, None])
                else:
                    p_value = dickey_fuller_p(best[1])
                    out.append([*own, best[1], p_value, best[2], n, p_value < 0.05])
            names = [*keys, "adf_stat", "p_value", "used_lag", "n_obs", "stationary"]
            frame = pd.DataFrame(out, columns=names)
            frame["used_lag"] = frame["used_lag"].astype("Int32")
            frame["stationary"] = frame["stationary"].astype("boolean")
            yield frame

    return sums.mapInPandas(solve, schema)


def best_lags(
    curve: DataFrame, information: DataFrame, top_n: int = 10
) -> DataFrame:
    """Lags by autocorrelation, partial autocorrelation and information, and all three combined.

    Correlations count beyond 1.96 / sqrt(n).  The combined list goes by mean
    rank over the lists; a lag missing from one takes the rank after its end.
    One row per lag, so the tables fit anywhere.
    """
    rows = sorted(curve.collect(), key=lambda r: r["lag"])
    bound = 1.96 / sqrt(rows[0]["n"]) if rows else 0.0
    mi = {r["lag"]: r["mutual_information"] for r in information.collect()}

    def top(scores: dict[int, float]) -> dict[int, int]:
        ordered = sorted(scores, key=lambda k: (-round(scores[k], 9), k))[:top_n]
        return {k: i + 1 for i, k in enumerate(ordered)}

    lists = [
        top({r["lag"]: abs(r["acf"]) for r in rows if abs(r["acf"]) > bound}),
        top({r["lag"]: abs(r["pacf"]) for r in rows if abs(r["pacf"]) > bound}),
        top(mi),
    ]
    ranks = {
        k: sum(l.get(k, len(l) + 1) for l in lists) / 3 for k in sorted({k for l in lists for k in l})
    }
    chosen = sorted(ranks, key=lambda k: (ranks[k], k))[:top_n]
    out = [
        (k, *(l.get(k) for l in lists), ranks[k], k in chosen) for k in sorted(ranks)
    ]
    return curve.sparkSession.createDataFrame(
        out, "lag int, acf_rank int, pacf_rank int, mi_rank int, mean_rank double, recommended boolean"
    )


def anova(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """One-way F test of a value over each grouping column, from per-group sums."""
    pairs = F.array(*[
        F.struct(F.lit(g).alias("stratum"), F.col(g).cast("string").alias("level")) for g in groups
    ])
    cells = (
        df.where(F.col(value).isNotNull()).select(F.col(value).alias("y"), F.inline(pairs))
        .where("level is not null").groupBy("stratum", "level")
        .agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    )
    totals = cells.groupBy("stratum").agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m"))
         - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"),
    )
    f = F.try_divide(
        F.col("between") / F.nullif(F.col("groups") - 1, F.lit(0)),
        F.col("within") / F.nullif(F.col("rows") - F.col("groups"), F.lit(0)),
    )
    ratio = F.try_divide(F.col("between"), F.col("between") + F.col("within"))

    @F.pandas_udf("double")
    def p_value(stat: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(s) else f_tail(s, a - 1, b - a) for s, a, b in zip(stat, k, n)], dtype="float64"
        )

    tested = totals.select(
        "stratum", "groups", f.alias("f_stat"), ratio.alias("variance_ratio"), "rows",
    ).withColumn("p_value", p_value("f_stat", "groups", "rows"))
    return tested.withColumn("useful", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
