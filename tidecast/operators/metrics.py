"""Errors of predictions, grades, diagnosis and log scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.order import join_keys

# Fixed values of the grades and the diagnosis.
ACCEPTABLE, MARGINAL, TOO_PERFECT = 0.50, 0.25, 0.98
UNSTABLE, MARGIN = 0.3, 0.02
ERROR_OVER_STD, CV_NEAR_ZERO, CV_GAP, HEAVY_SKEW = 1.0, 0.05, 0.25, 2.0


def evaluate(df: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "prediction") -> DataFrame:
    """R2, RMSE, MAE, residual summary, MAPE and target statistics per group.

    MAPE stays null when the target holds a zero.  Sums are partial before the
    shuffle, so large groups cost no more than small ones.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    sst = F.count("*") * F.var_pop(y)
    zeros = F.count_if(F.col(y) == 0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("residual_mean"),
        F.max(F.abs(e)).alias("residual_max_abs"),
        F.when(zeros == 0, F.avg(F.try_divide(F.abs(e), F.abs(y)))).alias("mape"),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
    ).withColumn("model_worse_than_mean_baseline", F.coalesce(F.col("r2") < 0, F.lit(False)))


def grade(best_r2: Column) -> Column:
    return (
        F.when(best_r2 >= ACCEPTABLE, "acceptable").when(best_r2 >= MARGINAL, "marginal").otherwise("subpar")
    )


def quality(metrics: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Grade of a run by its best candidate."""
    best = metrics.groupBy(*run_cols).agg(F.max("r2").alias("best_r2"))
    return best.withColumn("quality_assessment", grade(F.col("best_r2")))


def against_baseline(metrics: DataFrame, naive: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """Put the naive metrics of the run next to each candidate."""
    base = naive.select(
        *run_cols, F.col("r2").alias("naive_baseline_r2"), F.col("rmse").alias("naive_baseline_rmse"),
        F.col("mae").alias("naive_baseline_mae"),
    )
    if run_cols:
        return metrics.join(base, list(run_cols), "left")
    # Without runs the baseline is a single row.
    row = base.first()
    return metrics.withColumns({c: F.lit(row[c] if row else None).cast("double") for c in base.columns})


def cv_summary(folds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and spread of the fold scores; unstable when they vary by more than 0.3 of the mean."""
    out = folds.groupBy(*by).agg(
        F.avg("r2").alias("cv_mean_r2"), F.stddev_samp("r2").alias("cv_std_r2"),
        F.avg("rmse").alias("cv_mean_rmse"), F.avg("mae").alias("cv_mean_mae"), F.count("*").alias("folds"),
    )
    unstable = F.try_divide(F.col("cv_std_r2"), F.abs("cv_mean_r2")) > UNSTABLE
    return out.withColumn("cv_unstable", F.coalesce(unstable, F.lit(False)))


def benchmark_deltas(candidates: DataFrame, benchmarks: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """R2 gained over ARIMA and k-means of the same run.

    The warning is set when the best candidate of a run gains less than 0.02
    over either, or when one of the two is missing.
    """
    names, keys = ("arima", "kmeans"), list(run_cols)
    base = benchmarks.groupBy(*keys).agg(*[
        F.max(F.when(F.col("model") == f"{b}_benchmark", F.col("r2"))).cast("double").alias(f"_{b}") for b in names])
    best = candidates.groupBy(*keys).agg(F.max("r2").cast("double").alias("_best"))
    joined = candidates
    for one in (base, best):
        if keys:
            joined = join_keys(joined, one, keys, "left")
        else:
            row = one.first()
            joined = joined.withColumns({c: F.lit(row[c] if row else None).cast("double") for c in one.columns})
    short = reduce(lambda x, y: x | y, [F.coalesce(F.col("_best") - F.col(f"_{b}") < MARGIN, F.lit(True)) for b in names])
    return joined.withColumns({
        **{f"delta_r2_vs_{b}": F.col("r2") - F.col(f"_{b}") for b in names}, "benchmark_warning": short,
    }).drop("_arima", "_kmeans", "_best")


def best_by_holdout(candidates: DataFrame, run_cols: Sequence[str] = ()) -> DataFrame:
    """The candidate with the highest holdout R2 of each run; CV never decides."""
    order = Window.partitionBy(*(run_cols or [F.lit(0)])).orderBy(
        F.round("r2", 6).desc_nulls_last(), "model"
    )
    return candidates.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def expansion_diagnosis(candidates: DataFrame, target_skewness: float) -> DataFrame:
    """Likely causes of poor scores, one flag each.

    Reads ``rmse``, ``target_std``, ``cv_mean_r2`` and ``r2``.
    """
    return candidates.withColumns({
        "not_learning": F.coalesce(F.try_divide(F.col("rmse"), F.col("target_std")) > ERROR_OVER_STD, F.lit(False)),
        "uninformative_features": F.coalesce(F.abs("cv_mean_r2") < CV_NEAR_ZERO, F.lit(False)),
        "overfitting": F.coalesce(F.col("cv_mean_r2") - F.col("r2") > CV_GAP, F.lit(False)),
        "log_transform_advised": F.lit(abs(target_skewness) > HEAVY_SKEW),
    })


def residual_histogram(df: DataFrame, bins: int = 30, y: str = "y", p: str = "prediction") -> DataFrame:
    """Counts of residuals in equal-width bins, empty bins left out."""
    rows = df.select((F.col(y) - F.col(p)).alias("e")).where("e is not null")
    lo, hi = rows.agg(F.min("e"), F.max("e")).first()
    if lo is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, residuals bigint")
    width = (hi - lo) / bins or 1.0
    number = F.least(F.floor((F.col("e") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(number.alias("bin")).agg(F.count("*").alias("residuals"))
    return counts.select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "residuals",
    )
