"""Column statistics, filters, correlation and structure checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.names import long_form
from tidecast.functions.stats import UNKNOWN, correlation_states, correlations, pearson
from tidecast.operators.order import over_order

# Fixed values of the screening rules.
LOW_VARIANCE = 1e-4
MANY_VALUES = 50
LEAK_CORRELATION = 0.98
REDUNDANT_CORRELATION = 0.90


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def column_classes(df: DataFrame) -> DataFrame:
    """Every column with its class."""
    numeric, categorical = set(numeric_columns(df)), set(categorical_columns(df))
    rows = [
        (c, "numeric" if c in numeric else "categorical" if c in categorical else "time")
        for c in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, "column string, column_class string")


def univariate_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    parts = {
        "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"),
        "missing_fraction": lambda c: F.avg(F.col(c).isNull().cast("double")),
    }
    wide = df.agg(*[make(c).alias(f"{c}|{p}") for c in cols for p, make in parts.items()])
    return long_form(wide, {c: {p: f"{c}|{p}" for p in parts} for c in cols})


def low_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance after min-max scaling; constant columns count as low."""
    wide = df.agg(*[
        F.coalesce(
            F.try_divide(F.var_samp(c), F.pow(F.max(c) - F.min(c), F.lit(2.0))), F.lit(0.0)
        ).alias(c)
        for c in cols
    ])
    flat = long_form(wide, {c: {"scaled_variance": c} for c in cols})
    return flat.withColumn("low_variance", F.col("scaled_variance") < LOW_VARIANCE)


def high_cardinality(df: DataFrame, cols: Sequence[str], exact: bool = False) -> DataFrame:
    """Distinct values of text columns; more than 50 is high.

    Counting exactly shuffles every distinct value, so a sketch is the default.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in cols])
    flat = long_form(wide, {c: {"distinct_values": c} for c in cols})
    return flat.withColumn("high_cardinality", F.col("distinct_values") > MANY_VALUES)


def target_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation with the target; one that cannot be known is suspect too."""
    found = correlation_states(df, [(f, target) for f in features])
    rows = [(f, r, state == UNKNOWN or (r is not None and abs(r) > LEAK_CORRELATION)) for (f, _), (r, state) in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, correlation double, leakage_suspect boolean")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, each over the rows where both are known."""
    rows = [(a, b, r) for (a, b), r in correlations(df, list(combinations(cols, 2))).items()]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the highest absolute correlation."""
    best = F.max_by(
        F.struct("column_a", "column_b", "correlation"),
        F.struct(F.coalesce(F.round(F.abs("correlation"), 6), F.lit(-1.0)), "column_a", "column_b"),
    ).alias("best")
    return pairs.agg(best).select("best.*")


def target_candidates(df: DataFrame, cols: Sequence[str], series_cols: Sequence[str] = ()) -> DataFrame:
    """Variance and lag-1 self-correlation of each column, highest variance first."""
    lagged = over_order(
        df.select(*series_cols, "t_idx", *cols),
        lambda w: {f"{c}|before": F.lag(c).over(w) for c in cols},
        behind=1, series_cols=series_cols,
    )
    wide = lagged.agg(
        *[F.var_samp(c).alias(f"{c}|var") for c in cols],
        *[pearson(c, f"{c}|before").alias(f"{c}|self") for c in cols],
    )
    flat = long_form(wide, {c: {"variance": f"{c}|var", "self_correlation": f"{c}|self"} for c in cols})
    # One row per column.
    rows = sorted(flat.collect(), key=lambda r: (-round(r["variance"] or 0.0, 6), r["column"]))
    return df.sparkSession.createDataFrame(
        [(*r, i + 1) for i, r in enumerate(rows)],
        "column string, variance double, self_correlation double, rank int",
    )


def detect_target(
    df: DataFrame,
    numeric: Sequence[str],
    heuristic: str = "highest_variance",
    explicit: str | None = None,
    time_col: str | None = None,
) -> tuple[str, DataFrame]:
    """The target column and the scores that chose it; constants never win."""
    if explicit is not None:
        if explicit not in numeric:
            raise ValueError(f"target {explicit} is not a numeric column")
        scores = [(explicit, "explicit", None, True)]
        schema = "column string, method string, score double, chosen boolean"
        return explicit, df.sparkSession.createDataFrame(scores, schema)
    score = {"highest_variance": "variance", "most_correlated_with_self": "self_correlation"}[heuristic]
    table = target_candidates(df, [c for c in numeric if c != time_col]).collect()
    usable = [r for r in table if (r["variance"] or 0.0) > 1e-12 and r[score] is not None]
    if not usable:
        raise ValueError("every numeric column is constant")
    best = min(usable, key=lambda r: (-round(r[score], 6), r["column"]))["column"]
    rows = [(r["column"], heuristic, r[score], r["column"] == best) for r in usable]
    schema = "column string, method string, score double, chosen boolean"
    return best, df.sparkSession.createDataFrame(rows, schema)


def step_seconds(df: DataFrame, time_col: str = "t", series_cols: Sequence[str] = ()) -> DataFrame:
    """Most common step between neighbours, in whole seconds; the smaller one on ties."""
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    stepped = over_order(
        df.select(*series_cols, "t_idx", micros.alias("_us")),
        lambda w: {"_before": F.lag("_us").over(w)},
        behind=1, series_cols=series_cols,
    )
    # Integer division keeps even long sub-second series to few distinct steps.
    steps = (
        stepped.where("_before is not null")
        .groupBy(*series_cols, F.expr("(_us - _before) div 1000000").alias("step_seconds"))
        .agg(F.count("*").alias("steps"))
    )
    return steps.groupBy(*series_cols).agg(
        F.max_by("step_seconds", F.struct("steps", -F.col("step_seconds"))).alias("step_seconds"),
        F.max("steps").alias("steps"),
    )


def frequency_label(seconds: int) -> str:
    for size, unit in ((604800, "w"), (86400, "d"), (3600, "h"), (60, "min")):
        if seconds and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def seasonal_periods(seconds: int) -> list[int]:
    """Steps per day, week, month and year worth trying for a given step."""
    if seconds >= 86400:
        return [7, 30, 365]
    per_day = max(86400 // max(seconds, 1), 2)
    return [per_day, 7 * per_day]


def series_id_check(df: DataFrame, time_col: str, id_cols: Sequence[str]) -> DataFrame:
    """A column identifies series when times repeat overall but never within it."""
    repeats = df.groupBy(time_col).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1)).first()[0]
    rows = []
    for c in id_cols:
        inside = df.groupBy(c, time_col).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1))
        clashes = inside.first()[0]
        rows.append((c, repeats, clashes, repeats > 0 and clashes == 0))
    return df.sparkSession.createDataFrame(
        rows, "column string, repeated_times bigint, clashes bigint, identifies_series boolean"
    )
