"""Cleansing: types, nulls, duplicates, outliers, time column, target, row log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.order import join_keys, last_known
from tidecast.operators.quantiles import exact_quantiles

# Types tried in this order.
CANDIDATE_TYPES = ["bigint", "double", "timestamp_ntz"]
TIME_SHARE = 0.95
FENCE = 1.5


def infer_types(df: DataFrame, hints: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cast text columns leniently; values that do not fit become null and are counted.

    A type is taken when every non-null value casts, or when hinted.  All
    columns and types are judged in one pass.
    """
    hints = hints or {}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = []
    for c in text:
        counts.append(F.count(c).alias(f"{c}|n"))
        for t in [hints[c]] if c in hints else CANDIDATE_TYPES:
            counts.append(F.count(F.col(c).try_cast(t)).alias(f"{c}|{t}"))
    row = df.agg(*counts).first().asDict() if text else {}
    chosen = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    report = []
    for c in df.columns:
        if c in text:
            n = row[f"{c}|n"]
            fits = [t for t in CANDIDATE_TYPES if n and row.get(f"{c}|{t}") == n]
            chosen[c] = hints.get(c) or (fits[0] if fits else "string")
            cast = row.get(f"{c}|{chosen[c]}", n)
            report.append((c, chosen[c], n, n - cast))
    typed = df.select(*[
        F.col(c).try_cast(chosen[c]).alias(c) if c in text else F.col(c) for c in df.columns
    ])
    schema = "column string, inferred_type string, non_null bigint, invalid_casts bigint"
    return typed, df.sparkSession.createDataFrame(report, schema)


def null_rates(df: DataFrame) -> DataFrame:
    """Null share, type, row and column count, one row per column, from one pass."""
    wide = df.agg(
        F.count("*").alias("#rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    entries = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.try_divide(F.col(f.name), F.col("#rows")).alias("null_rate"),
            F.col("#rows").alias("row_count"),
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        )
        for f in df.schema.fields
    ])
    return wide.select(F.inline(entries))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with the number of copies."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_summary(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).agg(
        F.count("*").alias("repeated_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
    )


def known(col: str) -> Column:
    """The column as a number, NaN as null."""
    return F.nullif(F.col(col).cast("double"), F.lit(float("nan")))


def outlier_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values beyond 1.5 interquartile ranges from the quartiles; NaN counts as null."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.75])
    counts = {}
    for c in cols:
        q1, q3 = quartiles[c]
        if q1 is None:
            counts[c] = (F.lit(None), F.lit(None), F.lit(0))
            continue
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        counts[c] = (F.lit(low), F.lit(high), F.count_if((known(c) < low) | (known(c) > high)))
    wide = df.agg(*[
        F.struct(
            F.lit(c).alias("column"),
            lo.cast("double").alias("low_fence"),
            hi.cast("double").alias("high_fence"),
            n.cast("bigint").alias("outliers"),
            F.count(known(c)).alias("values"),
        ).alias(c)
        for c, (lo, hi, n) in counts.items()
    ])
    return wide.select(F.inline(F.array(*[F.col(c) for c in cols])))


def time_column_candidates(df: DataFrame, exact: bool = True) -> DataFrame:
    """Columns that read as timestamps, best first.

    A column qualifies when 95 % of its values cast; the highest share of
    distinct values wins, then the leftmost.
    """
    dated = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, dated)]
    schema = "column string, time_share double, distinct_ratio double, chosen boolean"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    as_time = {c: F.col(c).try_cast("timestamp_ntz") for c in cols}
    shares = df.agg(
        *[F.try_divide(F.count(as_time[c]), F.count(c)).alias(c) for c in cols]
    ).first()
    fit = [c for c in cols if (shares[c] or 0.0) >= TIME_SHARE]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    ratios = (
        df.agg(*[F.try_divide(distinct(as_time[c]), F.count(as_time[c])).alias(c) for c in fit])
        .first().asDict() if fit else {}
    )
    best = max(fit, key=lambda c: (ratios[c], -cols.index(c)), default=None)
    rows = [(c, shares[c], ratios.get(c), c == best) for c in cols]
    return df.sparkSession.createDataFrame(rows, schema)


def validate_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a target, and the check behind them; raises when none can be used."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"target column {target} is not numeric")
    check = df.agg(
        F.lit(target).alias("target_column"),
        F.count("*").alias("row_count_before"),
        F.count_if(F.col(target).isNull()).alias("null_targets"),
        F.count(target).alias("row_count_after"),
    )
    if check.first()["row_count_after"] == 0:
        raise ValueError(f"no rows left with a value in {target}")
    return df.where(F.col(target).isNotNull()), check


def accounted_filters(
    df: DataFrame, stages: Sequence[tuple[str, Column, str]]
) -> tuple[DataFrame, DataFrame]:
    """Keep the rows that pass every stage; log rows in, rows out and the reason.

    Each row is charged to the first stage it fails, so one pass serves the log.
    """
    fails_at = F.lit(len(stages))
    for i in reversed(range(len(stages))):
        fails_at = F.when(F.coalesce(stages[i][1], F.lit(False)), fails_at).otherwise(F.lit(i))
    judged = df.withColumn("_fails_at", fails_at)
    wide = judged.agg(*[
        F.count_if(F.col("_fails_at") >= i).alias(f"in{i}") for i in range(len(stages) + 1)
    ])
    entries = F.array(*[
        F.struct(
            F.lit(i + 1).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(f"in{i}").alias("rows_in"),
            F.col(f"in{i + 1}").alias("rows_out"),
            F.lit(reason).alias("reason"),
        )
        for i, (name, _, reason) in enumerate(stages)
    ])
    kept = judged.where(F.col("_fails_at") == len(stages)).drop("_fails_at")
    return kept, wide.select(F.inline(entries))


def fill_nulls(
    df: DataFrame,
    col: str,
    how: str,
    value: float | None = None,
    out: str | None = None,
    series_cols: Sequence[str] = (),
    index: str = "t_idx",
    fitted_on: Column | None = None,
) -> DataFrame:
    """Treat nulls of one column: ``drop``, ``constant``, ``mean`` or ``forward``; NaN counts as null.

    The mean is each series' own, over the rows that meet ``fitted_on`` (such as
    the training rows); a series without a value there keeps its nulls.
    """
    out = out or col
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        df = df.withColumn(col, F.nullif(F.col(col), F.lit(float("nan"))))
    if how == "drop":
        return df.where(F.col(col).isNotNull()).withColumn(out, F.col(col))
    if how == "constant":
        return df.withColumn(out, F.coalesce(F.col(col), F.lit(value)))
    if how == "mean":
        fitted = df if fitted_on is None else df.where(fitted_on)
        if not series_cols:
            return df.withColumn(out, F.coalesce(F.col(col), F.lit(fitted.agg(F.avg(col)).first()[0])))
        means = fitted.groupBy(*series_cols).agg(F.avg(col).alias("_mean"))
        return join_keys(df, means, series_cols, "left").withColumn(out, F.coalesce(F.col(col), F.col("_mean"))).drop("_mean")
    if how == "forward":
        return last_known(df, col, out, series_cols, index)
    raise ValueError(f"unknown null treatment {how}")
