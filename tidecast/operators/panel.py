"""Ridge regressions of every series of a panel, searched and validated in one job.

A row belongs to one segment of its series: the stretches between the bounds of
the folds, and the holdout.  Moments of each segment are partial before the
shuffle; a series is then a handful of small matrices, whatever its length, and
all folds, penalties and the final fit are solved from their sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.order import join_keys
from tidecast.operators.split import FOLDS, HOLDOUT_SHARE
from tidecast.operators.stattests import moments, unpack
from tidecast.storage import written_table

PENALTIES = (0.0, 0.01, 0.1, 1.0)
HELD_OUT = -1


def segments(df: DataFrame, series_cols: Sequence[str], folds: int = FOLDS, index: str = "t_idx") -> DataFrame:
    """Add ``_segment``: 0 before the first fold's training ends, then one a fold width, ``HELD_OUT`` in the holdout.

    Fold i trains on segments up to i, leaves out i + 1 and tests on i + 2.
    """
    keys = list(series_cols)
    sizes = df.groupBy(*keys).agg(F.floor((1 - HOLDOUT_SHARE) * (F.max(index) + 1)).alias("_n")).withColumn(
        "_width", F.expr(f"_n div {folds + 2}")).where("_width > 0")
    from_first = F.floor((F.col(index) - (F.col("_n") - (folds + 1) * F.col("_width"))) / F.col("_width")) + 1
    return join_keys(df, sizes, keys).withColumn("_segment", F.when(F.col(index) >= F.col("_n"), HELD_OUT).otherwise(
        F.greatest(from_first, F.lit(0)))).drop("_n", "_width")


def _solved(v: np.ndarray, width: int, penalty: float):
    """Intercept and coefficients for (C + penalty * diag C) b = c; None when singular or without rows."""
    if v[0] < 2:
        return None
    _, mean, cov = unpack(v, width)
    x = cov[:-1, :-1] + penalty * np.diag(np.diag(cov)[:-1])
    try:
        beta = np.linalg.solve(x, cov[:-1, -1])
    except np.linalg.LinAlgError:
        return None
    return (mean[-1] - beta @ mean[:-1], beta) if np.isfinite(beta).all() else None


def _scored(v: np.ndarray, width: int, model) -> tuple[float | None, float | None]:
    """R2 and RMSE on the rows behind the moments."""
    if model is None or v[0] < 1:
        return None, None
    _, mean, cov = unpack(v, width)
    a, beta = model
    square = (mean[-1] - a - beta @ mean[:-1]) ** 2 + cov[-1, -1] - 2 * beta @ cov[:-1, -1] + beta @ cov[:-1, :-1] @ beta
    square = max(float(square), 0.0)
    return (1 - square / float(cov[-1, -1]) if cov[-1, -1] > 0 else None), square**0.5


def _series_results(keys: list[str], width: int, folds: int, penalties: Sequence[float]):
    length = 1 + width + width * (width + 1) // 2

    def run(batches):
        for pdf in batches:
            rows = []
            for *key, parts in pdf[[*keys, "parts"]].itertuples(index=False):
                by = {p["_segment"]: np.array(p["v"]) for p in parts}
                part = [by.get(i, np.zeros(length)) for i in range(folds + 2)]
                found = {}
                for penalty in penalties:
                    for f in range(folds):
                        found[penalty, f] = _scored(part[f + 2], width, _solved(sum(part[: f + 1]), width, penalty))
                means = {}
                for penalty in penalties:
                    cv = [found[penalty, f][0] for f in range(folds) if found[penalty, f][0] is not None]
                    if cv:
                        means[penalty] = (float(np.mean(cv)), float(np.std(cv, ddof=1)) if len(cv) > 1 else None)
                # The smallest penalty of those that are alike to nine digits.
                best = max(means, key=lambda p: (round(means[p][0], 9), -p), default=None)
                model = None if best is None else _solved(sum(part), width, best)
                r2, rmse = _scored(by.get(HELD_OUT, np.zeros(length)), width, model)
                results = [{"penalty": float(p), "fold": f, "r2": x[0], "rmse": x[1]} for (p, f), x in found.items()]
                rows.append([*key, best, *means.get(best, (None, None)), r2, rmse, None if model is None else float(model[0]),
                             None if model is None else model[1].tolist(), results])
            yield pd.DataFrame(rows, columns=[*keys, "penalty", "cv_mean_r2", "cv_std_r2", "r2", "rmse", "intercept", "coefficients", "folds"])
    return run


def panel_ridge(
    df: DataFrame, features: Sequence[str], series_cols: Sequence[str], penalties: Sequence[float] = PENALTIES, folds: int = FOLDS,
) -> DataFrame:
    """``penalty, cv_mean_r2, cv_std_r2, r2, rmse, intercept, coefficients, folds`` of each series.

    The penalty with the best mean R2 over the folds is refitted on all training
    rows and scored on the holdout; it is relative to each feature's variance.
    ``folds`` lists R2 and RMSE of every penalty and fold.  Rows with a null
    feature or target take no part.  A series too short for the folds has no
    row; one without a solvable fit has null results.
    """
    keys, cols = list(series_cols), [*features, "y"]
    known = segments(df.select(*keys, "t_idx", *cols), keys, folds).dropna(subset=cols)
    centre = known.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shifted = known.select(*keys, "_segment", *[(F.col(c) - F.lit(centre[c] or 0.0)).alias(c) for c in cols])
    sums = moments(shifted, cols, [*keys, "_segment"])
    parts = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_segment").cast("int").alias("_segment"), "v")).alias("parts"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = parts.mapInPandas(
        _series_results(keys, len(cols), folds, list(penalties)),
        ", ".join(f"`{k}` {types[k]}" for k in keys) + ", penalty double, cv_mean_r2 double, cv_std_r2 double, r2 double, rmse double, "
        "intercept double, coefficients array<double>, folds array<struct<penalty:double,fold:int,r2:double,rmse:double>>")
    moved = [F.col("coefficients")[i] * F.lit(centre[f] or 0.0) for i, f in enumerate(features)]
    back = F.col("intercept") + F.lit(centre["y"] or 0.0) - sum(moved, F.lit(0.0))
    return written_table(found.withColumn("intercept", back), "panel-ridge")


def panel_predictions(df: DataFrame, models: DataFrame, features: Sequence[str], series_cols: Sequence[str]) -> DataFrame:
    """Add ``prediction`` by each series' own model; null without one or with a null feature."""
    fitted = models.select(*series_cols, F.col("intercept").alias("_a"), F.col("coefficients").alias("_b"))
    prediction: Column = F.col("_a")
    for i, f in enumerate(features):
        prediction = prediction + F.col("_b")[i] * F.col(f)
    return join_keys(df, fitted, list(series_cols), "left").select(*df.columns, prediction.alias("prediction"))
