"""Causal features.

Everything built from the target uses rows before the current one only.  A
feature says how far back it starts and reaches; the audit in ``leakage``
checks that claim on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidecast.operators.order import dense_index, join_keys, over_order
from tidecast.operators.profile import numeric_columns


@dataclass(frozen=True)
class Feature:
    """A column over the ordered window, with the nearest and farthest row it reads."""

    name: str
    make: Callable[[WindowSpec], Column]
    nearest: int = 0
    farthest: int = 0
    tags: tuple[str, ...] = ()


def build(df: DataFrame, features: Sequence[Feature], series_cols: Sequence[str] = ()) -> DataFrame:
    """Add all features in one pass: one shuffle and one sort for every window."""
    reach = max((f.farthest for f in features), default=0)
    if reach == 0:
        return df.withColumns({f.name: f.make(None) for f in features})
    return over_order(
        df, lambda w: {f.name: f.make(w) for f in features}, behind=reach, series_cols=series_cols
    )


def lag_features(col: str, lags: Sequence[int], prefix: str = "y", tag: str = "target") -> list[Feature]:
    if any(k < 1 for k in lags):
        raise ValueError("lags start at 1: lag 0 is the value itself")
    return [
        Feature(f"{prefix}_lag_{k}", lambda w, k=k: F.lag(col, k).over(w), k, k, (tag, "lag")) for k in lags
    ]


def rolling_features(col: str, windows: Sequence[int] = (7, 14, 30), prefix: str = "y") -> list[Feature]:
    """Mean, standard deviation, minimum, maximum and range of the ``w`` rows before each row.

    Null until ``w`` values are there.
    """
    kinds = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }

    def stat(fn, n):
        def make(w):
            before = w.rowsBetween(-n, -1)
            return F.when(F.count(col).over(before) == n, fn(col).over(before))
        return make

    out = []
    for n in windows:
        for kind, fn in kinds.items():
            out.append(Feature(f"{prefix}_rolling_{kind}_{n}", stat(fn, n), 1, n, ("target", "rolling")))
        spread = lambda w, n=n: stat(F.max, n)(w) - stat(F.min, n)(w)
        out.append(Feature(f"{prefix}_rolling_range_{n}", spread, 1, n, ("target", "rolling")))
    return out


def differencing_features(col: str, steps: Sequence[int] = (1, 7), prefix: str = "y") -> list[Feature]:
    """Differences of the series as it stood one row ago, the second difference and the relative change."""
    def back(w, k):
        return F.lag(col, k).over(w)

    tags = ("target", "diff")
    out = [
        Feature(f"{prefix}_diff_{k}", lambda w, k=k: back(w, 1) - back(w, 1 + k), 1, 1 + k, tags) for k in steps
    ]
    out.append(Feature(
        f"{prefix}_diff_2", lambda w: back(w, 1) - 2 * back(w, 2) + back(w, 3), 1, 3, tags))
    out.append(Feature(
        f"{prefix}_pct_change_1", lambda w: F.try_divide(back(w, 1) - back(w, 2), back(w, 2)), 1, 2, tags))
    return out


def embedding_features(col: str, delay: int, dim: int = 3, prefix: str = "y") -> list[Feature]:
    """Delay embedding of the past: rows 1, 1 + delay, 1 + 2 delay back."""
    return [
        Feature(
            f"{prefix}_emb_{i}", lambda w, k=1 + i * delay: F.lag(col, k).over(w),
            1 + i * delay, 1 + i * delay, ("target", "embedding"),
        )
        for i in range(dim)
    ]


def calendar_features(time_col: str = "t") -> list[Feature]:
    parts = {
        "hour": F.hour, "day_of_week": F.weekday, "month": F.month, "quarter": F.quarter, "year": F.year,
        "is_weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    }
    return [Feature(n, lambda w, f=f: f(F.col(time_col)), tags=("calendar",)) for n, f in parts.items()]


def fourier_features(period: float, harmonics: Sequence[int] = (1, 2)) -> list[Feature]:
    """Sine and cosine of the row position for a period and its harmonics."""
    def wave(fn, k):
        return lambda w: fn(F.lit(2 * pi * k) * F.col("t_idx") / F.lit(float(period)))

    return [
        Feature(f"{name}_{k}", wave(fn, k), tags=("fourier",))
        for k in harmonics for name, fn in (("sin", F.sin), ("cos", F.cos))
    ]


def trend_features(df: DataFrame, time_col: str = "t", series_cols: Sequence[str] = ()) -> DataFrame:
    """Row position, its square, and days since the start of the series."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    keys = list(series_cols)
    if keys:
        starts = df.groupBy(*keys).agg(F.min(micros).alias("_start"))
        df = join_keys(df, starts, keys)
        start = F.col("_start")
    else:
        start = F.lit(df.agg(F.min(micros)).first()[0])
    return df.withColumns({
        "t_index": F.col("t_idx").cast("double"),
        "t_index_squared": F.col("t_idx").cast("double") * F.col("t_idx").cast("double"),
        "t_elapsed_days": (micros - start) / F.lit(86_400_000_000.0),
    }).drop("_start")


def strata(step_seconds: int, span_days: float) -> list[str]:
    """Which time strata the step and the length of the data allow."""
    active = ["day_of_week"]
    if step_seconds <= 3600:
        active.insert(0, "hour_of_day")
    if span_days >= 60:
        active.append("month")
    if span_days >= 180:
        active.append("season")
    return active


def strata_features(df: DataFrame, step_seconds: int, time_col: str = "t") -> DataFrame:
    t = F.col(time_col)
    ends = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    span = (ends["b"] - ends["a"]).total_seconds() / 86400
    columns = {
        "hour_of_day": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t),
        "season": F.floor(F.pmod(F.month(t), F.lit(12)) / 3).cast("int"),
    }
    return df.withColumns({name: columns[name] for name in strata(step_seconds, span)})


def seasonal_lags(lags: Sequence[int], seasonal_lag: int) -> list[int]:
    return [k for k in lags if k % seasonal_lag == 0]


def cross_series_mean(
    df: DataFrame, series_cols: Sequence[str], col: str = "y", time_col: str = "t"
) -> DataFrame:
    """Mean of the other series at the previous row's time.

    Totals per time are joined back and the own value is taken out, so no pair
    of series is ever formed.
    """
    totals = df.groupBy(time_col).agg(F.sum(col).alias("_sum"), F.count(col).alias("_n"))
    own = F.coalesce(F.col(col), F.lit(0.0))
    others = F.try_divide(F.col("_sum") - own, F.col("_n") - F.col(col).isNotNull().cast("int"))
    joined = join_keys(df, totals, [time_col]).withColumn("_others", others).drop("_sum", "_n")
    ready = over_order(
        joined, lambda w: {"others_mean_lag_1": F.lag("_others", 1).over(w)}, behind=1, series_cols=series_cols
    )
    return ready.drop("_others")


def series_codes(df: DataFrame, series_cols: Sequence[str], name: str = "series_id") -> DataFrame:
    """Add a number for each series, 0 for the longest, ties by the series columns.

    Numbers come from a range sort of one row a series and go to the rows by a
    join, so any number of series will do.
    """
    keys = list(series_cols)
    sizes = df.groupBy(*keys).agg((-F.count("*")).alias("_less"))
    codes = dense_index(sizes, ["_less", *keys], name="_code")
    return join_keys(df, codes.select(*keys, F.col("_code").cast("double").alias(name)), keys)


def interaction_features(col: str, lags: Sequence[int], prefix: str = "y") -> list[Feature]:
    """Products of the top lags."""
    pairs = [(a, b) for i, a in enumerate(lags) for b in lags[i + 1:]]
    return [
        Feature(
            f"{prefix}_lag_{a}_x_lag_{b}",
            lambda w, a=a, b=b: F.lag(col, a).over(w) * F.lag(col, b).over(w),
            min(a, b), max(a, b), ("target", "interaction"),
        )
        for a, b in pairs
    ]


def adaptive_features(
    col: str, profile: dict, significant: Sequence[int], seasonal_lag: int | None, long_series: bool = False
) -> list[Feature]:
    """Features the profile of the series calls for.

    White noise gets trivial lags only.  A trend or a unit root adds
    differences, seasonality adds seasonal lags and waves, a stationary series
    its significant lags.
    """
    if profile.get("white_noise"):
        return lag_features(col, [1])
    lags = {1}
    out: list[Feature] = []
    if profile.get("trend_detected") or profile.get("stationary") is False:
        out += differencing_features(col, (1, 7, 365) if long_series else (1, 7))
    if profile.get("seasonality_detected") and seasonal_lag:
        lags |= {*seasonal_lags(significant, seasonal_lag), seasonal_lag}
        out += fourier_features(seasonal_lag)
    if profile.get("stationary"):
        lags |= set(significant)
    return lag_features(col, sorted(lags)) + out


def features_for_models(
    col: str, models: Sequence[str], have: Sequence[str], top_lags: Sequence[int],
    delay: int = 1, period: int | None = None, pairs_of: int | None = None,
) -> list[Feature]:
    """Features that named model types still need.

    Interactions are made of all ``top_lags``, or of the first ``pairs_of``.
    """
    wanted: list[Feature] = []
    for model in models:
        if model in ("ARIMA", "SARIMA"):
            wanted += differencing_features(col, (1,))
        elif model in ("LSTM", "Temporal CNN"):
            wanted += embedding_features(col, delay)
        elif model in ("Gradient Boosting", "Tree-Based"):
            wanted += interaction_features(col, list(top_lags)[:pairs_of])
        elif model == "State-Space" and period:
            wanted += fourier_features(period)
    seen, out = set(have), []
    for f in wanted:
        if f.name not in seen:
            seen.add(f.name)
            out.append(f)
    return out


def drop_warm_up(df: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """Leave out each series' first ``reach`` rows, and say how many that were."""
    log = df.agg(
        F.count_if(F.col("t_idx") < reach).alias("rows_dropped_by_lags"),
        F.count_if(F.col("t_idx") >= reach).alias("final_row_count"),
    )
    return df.where(F.col("t_idx") >= reach), log


def validate_feature_count(names: Sequence[str]) -> None:
    if len(names) < 2:
        raise ValueError(f"Too few features: {len(names)}")


# What each model type needs, as patterns of feature names.
REQUIREMENTS = {
    "Gradient Boosting": ["lag", "rolling", "hour|day|month|quarter|year", "t_index"],
    "SARIMA": ["diff_1", "diff_2", "sin_|cos_|seasonal"],
    "LSTM": ["emb_"],
    "Linear Models": ["lag", "rolling"],
    "State-Space": ["t_index", "sin_|cos_"],
    "Tree-Based": ["lag", "rolling", "hour|day|month|quarter|year"],
}


def preselect_models(names: DataFrame, profile: dict, name_col: str = "feature") -> DataFrame:
    """Score each model type by the share of its needs present, moved by series flags.

    ``profile`` may say ``rows``, ``seasonality_detected``, ``trend_detected``
    and ``nonlinear`` (much information, little autocorrelation).
    """
    name = F.col(name_col)
    present = names.agg(*[
        F.coalesce(F.bool_or(name.rlike(p)), F.lit(False)).alias(f"{m}|{i}")
        for m, ps in REQUIREMENTS.items() for i, p in enumerate(ps)
    ]).first()
    bonus = {m: 0.0 for m in REQUIREMENTS}
    if profile.get("seasonality_detected"):
        bonus["SARIMA"] += 0.1
        bonus["State-Space"] += 0.1
    if profile.get("trend_detected"):
        bonus["State-Space"] += 0.1
    bonus["LSTM"] -= 0.0 if profile.get("rows", 0) > 500 else 0.5
    if profile.get("nonlinear"):
        bonus["Linear Models"] -= 0.5
        bonus["Gradient Boosting"] += 0.1
    rows = []
    for m, patterns in REQUIREMENTS.items():
        missing = [p for i, p in enumerate(patterns) if not present[f"{m}|{i}"]]
        score = min(1.0, max(0.0, 1 - len(missing) / len(patterns) + bonus[m]))
        suit = "suitable" if score >= 0.7 else "somewhat suitable" if score >= 0.4 else "not suitable"
        rows.append((m, round(score, 6), suit, patterns, missing))
    rows.sort(key=lambda x: (-x[1], x[0]))
    return names.sparkSession.createDataFrame(
        [(*x, i + 1, i < 3) for i, x in enumerate(rows)],
        "model_type string, score double, suitability string, required_features array<string>, "
        "required_features_missing array<string>, rank int, top_3 boolean",
    )


def model_subsets(names: Sequence[str], models: Sequence[str]) -> dict[str, list[str]]:
    """Feature names per model type: differences for SARIMA, everything for trees."""
    def pick(*parts: str) -> list[str]:
        return [n for n in names if any(p in n for p in parts)]

    rules = {
        "SARIMA": pick("diff", "sin_", "cos_"),
        "LSTM": pick("emb_", "_lag_"),
        "Linear Models": pick("_lag_", "rolling", "sin_", "cos_", "t_index"),
        "State-Space": pick("t_index", "sin_", "cos_"),
    }
    return {m: rules.get(m) or list(names) for m in models}


# The scaler each model type takes.
SCALERS = {
    "Linear Models": "StandardScaler", "SARIMA": "StandardScaler", "State-Space": "StandardScaler",
    "LSTM": "MinMaxScaler", "Gradient Boosting": None, "Tree-Based": None,
}


def scaling_metadata(df: DataFrame, target: str, models: Sequence[str]) -> DataFrame:
    """Scaler per model and feature; columns of zeros and ones are never scaled."""
    names = [c for c in numeric_columns(df) if c != target]
    other = df.agg(*[F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in names]).first()
    rows = []
    for c in names:
        binary = other[c] == 0
        rows += [(m, c, None if binary else SCALERS[m], binary) for m in models]
    return df.sparkSession.createDataFrame(
        rows, "model_type string, feature string, scaler string, never_scale boolean"
    )


def target_distribution(df: DataFrame, col: str) -> DataFrame:
    """Moments, quartile range and how well the target suits tree models.

    NaN counts as null; a target without values has null statistics and is not
    suitable.
    """
    from tidecast.operators.quantiles import exact_quantiles

    q1, q3 = exact_quantiles(df, [col], [0.25, 0.75])[col]
    known = F.nullif(F.col(col).cast("double"), F.lit(float("nan")))
    outside = F.lit(None) if q1 is None else (known < q1 - 1.5 * (q3 - q1)) | (known > q3 + 1.5 * (q3 - q1))
    stats = df.agg(
        F.min(known).alias("min"), F.max(known).alias("max"), F.avg(known).alias("mean"),
        F.stddev_samp(known).alias("std"), F.skewness(known).alias("skewness"), F.kurtosis(known).alias("kurtosis"),
        F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"),
        F.avg(outside.cast("double")).alias("outlier_fraction"),
    ).withColumn("cv", F.try_divide(F.col("std"), F.abs("mean")))
    good = reduce(lambda a, b: a + b, [
        F.coalesce(c, F.lit(False)).cast("int")
        for c in (F.col("outlier_fraction") < 0.05, F.col("cv") < 1.0, F.abs("skewness") < 1)
    ])
    verdict = (
        F.when(F.col("cv") > 3.0, "not suitable").when(good == 3, "yes")
        .when(good >= 1, "conditional").otherwise("not suitable")
    )
    return stats.withColumn("tree_model_suitable", verdict)
