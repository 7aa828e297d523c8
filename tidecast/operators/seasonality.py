"""Trend and seasonal strength by classical decomposition, and the model families they suggest."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.order import join_keys, over_order

# Fixed values of the strength labels.
WEAK, STRONG = 0.2, 0.5
TREND_STRENGTH = 0.5


def _moving_average(w, y: str, period: int) -> Column:
    half = period // 2
    frame = w.rowsBetween(-half, half)
    full = F.count(y).over(frame) == 2 * half + 1
    total = F.sum(y).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(y, half).over(w) + F.lead(y, half).over(w)) / 2
    return F.when(full, total / period)


def strengths(
    df: DataFrame, col: str, periods: Sequence[int], series_cols: Sequence[str] = ()
) -> DataFrame:
    """Seasonal and trend strength for each candidate period.

    The seasonal part is the mean of each phase, so the spread of the remainder
    is the spread inside the phases.  One row per period and phase is shuffled;
    nothing is joined back to the rows.
    """
    keys, most = list(series_cols), max(periods) // 2
    smooth = over_order(
        df.select(*keys, "t_idx", F.col(col).alias("y")),
        lambda w: {f"trend{p}": _moving_average(w, "y", p) for p in periods},
        behind=most, ahead=most, series_cols=keys,
    )
    entries = F.array(*[
        F.struct(
            F.lit(p).alias("period"), F.pmod("t_idx", F.lit(p)).alias("phase"),
            (F.col("y") - F.col(f"trend{p}")).alias("d"),
        )
        for p in periods
    ])
    cells = (
        smooth.select(*keys, "y", F.inline(entries)).where("d is not null")
        .groupBy(*keys, "period", "phase")
        .agg(
            F.count("*").alias("n"), F.avg("d").alias("md"), F.var_pop("d").alias("vd"),
            F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.covar_pop("y", "d").alias("c"),
        )
    )
    n, gap = F.col("n"), F.col("my") - F.col("md")
    total = cells.groupBy(*keys, "period").agg(
        F.sum("n").alias("rows"),
        F.sum(n * F.col("vd")).alias("remainder"),
        (F.sum(n * (F.col("vd") + F.col("md") * F.col("md")))
         - F.pow(F.sum(n * F.col("md")), F.lit(2)) / F.sum("n")).alias("detrended"),
        (F.sum(n * (F.col("vy") + gap * gap))
         - F.pow(F.sum(n * gap), F.lit(2)) / F.sum("n")).alias("deseasoned"),
    )
    none = F.lit(0.0)
    return total.select(
        *keys, "period", "rows",
        F.greatest(none, 1 - F.try_divide(F.col("remainder"), F.col("detrended"))).alias("seasonal_strength"),
        F.greatest(none, 1 - F.try_divide(F.col("remainder"), F.col("deseasoned"))).alias("trend_strength"),
    )


def spectrum(df: DataFrame, col: str, periods: Sequence[int], series_cols: Sequence[str] = ()) -> DataFrame:
    """Share of the variance carried by one sine wave of each candidate period."""
    wave = {p: F.lit(2 * pi) * F.col("t_idx") / F.lit(p) for p in periods}
    wide = df.groupBy(*series_cols).agg(
        F.var_pop(col).alias("v"),
        *[F.covar_pop(F.col(col), F.cos(wave[p])).alias(f"c{p}") for p in periods],
        *[F.covar_pop(F.col(col), F.sin(wave[p])).alias(f"s{p}") for p in periods],
    )
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("period"),
            F.try_divide(
                2 * (F.col(f"c{p}") * F.col(f"c{p}") + F.col(f"s{p}") * F.col(f"s{p}")), F.col("v")
            ).alias("spectral_share"),
        )
        for p in periods
    ])
    return wide.select(*series_cols, F.inline(rows))


def strength_label(s: Column) -> Column:
    return (
        F.when(s > STRONG, "strong seasonality").when(s >= WEAK, "weak seasonality")
        .otherwise("no clear seasonality")
    )


def detect_seasonality(
    df: DataFrame, col: str, periods: Sequence[int], series_cols: Sequence[str] = ()
) -> DataFrame:
    """Strength, spectral share and label per period; the strongest period is dominant."""
    keys = list(series_cols)
    both = join_keys(strengths(df, col, periods, keys), spectrum(df, col, periods, keys), [*keys, "period"])
    first = F.struct(F.round("seasonal_strength", 6), -F.col("period"))
    best = both.groupBy(*keys).agg(F.max_by("period", first).alias("dominant_period"))
    joined = join_keys(both, best, keys) if keys else both.join(
        best, F.col("period") == F.col("dominant_period"), "left"
    )
    return joined.select(
        *keys, "period", "seasonal_strength", "trend_strength", "spectral_share",
        strength_label(F.col("seasonal_strength")).alias("label"),
        F.coalesce(F.col("period") == F.col("dominant_period"), F.lit(False)).alias("dominant"),
    )


def trend_line(df: DataFrame, col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Straight-line trend over the row position."""
    return df.groupBy(*series_cols).agg(
        F.regr_slope(col, "t_idx").alias("slope"), F.regr_r2(col, "t_idx").alias("trend_r2")
    )


def component_flags(strength: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Trend and seasonality flags from the strongest period."""
    best = strength.groupBy(*series_cols).agg(
        F.max("seasonal_strength").alias("seasonal_strength"), F.max("trend_strength").alias("trend_strength")
    )
    return best.select(
        *series_cols,
        (F.col("trend_strength") > TREND_STRENGTH).alias("trend_detected"),
        (F.col("seasonal_strength") >= WEAK).alias("seasonality_detected"),
    )


def recommend_families(profile: DataFrame) -> DataFrame:
    """Two or three model families per profile row.

    Reads ``stationary``, ``seasonality_detected``, ``white_noise`` and
    ``multiple_series``; unknown flags count as false.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def families(*names: str) -> Column:
        return F.array(*[F.lit(n) for n in names])

    rule = (
        F.when(flag("white_noise"), families("Naive", "Exponential Smoothing"))
        .when(flag("multiple_series"), families("XGBoost", "LightGBM"))
        .when(flag("seasonality_detected"), families("SARIMA", "Prophet", "XGBoost"))
        .when(flag("stationary"), families("Gradient Boosting", "Linear Regression"))
        .otherwise(families("SARIMA", "Prophet", "ETS"))
    )
    return profile.withColumn("model_recommendations", rule)
