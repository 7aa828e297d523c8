"""Proof that no feature sees the target's present or future."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.stats import UNKNOWN, correlation_states
from tidecast.operators.features import Feature, build
from tidecast.sources.files import write_parquet

THRESHOLD = 0.98
PROPER_LAG = re.compile(r"^y_lag_[1-9]\d*$")
CONFIRMED_R2 = 0.999


def detect_leakage(
    df: DataFrame, features: Sequence[str], target: str, threshold: float = THRESHOLD
) -> DataFrame:
    """Correlation of each feature with the target; proper target lags are exempt.

    A correlation that cannot be known (fewer than two rows with both values)
    makes a candidate of the feature, whatever its name.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    found = correlation_states(df, [(f, target) for f in features if f != target])
    rows = [
        (f, r, state == UNKNOWN or (r is not None and abs(r) >= threshold and not PROPER_LAG.match(f)))
        for (f, _), (r, state) in found.items()
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, correlation double, candidate boolean")


def reconstruction_probe(df: DataFrame, candidates: Sequence[str], target: str) -> float | None:
    """R2 of a small forest that rebuilds the target from the candidates."""
    if not candidates:
        return None
    rows = df.select(target, *candidates).na.drop()
    forest = RandomForestRegressor(numTrees=10, seed=42, labelCol=target, featuresCol="_x", maxDepth=10, maxBins=256)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(candidates), outputCol="_x"), forest]).fit(rows)
    return RegressionEvaluator(labelCol=target, metricName="r2").evaluate(model.transform(rows))


def causality_audit(
    df: DataFrame,
    plan: Callable[[str], list[Feature]],
    col: str = "y",
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """Change the target from probed rows on and see which features notice.

    Probes are spaced so that the past of each stays as it was: any change at
    a probe is information from its present or future.  Original and changed
    features are built side by side in one pass.
    """
    true_plan = plan(col)
    reach = max(max((f.farthest for f in true_plan), default=0), 1)
    period = 2 * reach + 2
    phase = F.pmod("t_idx", F.lit(period))
    changed = F.when(phase <= reach, F.lit(1000.0) - 3 * F.col(col)).otherwise(F.col(col))
    twin = [
        Feature(f"{f.name}|changed", f.make, f.nearest, f.farthest, f.tags) for f in plan("_changed")
    ]
    both = build(df.withColumn("_changed", changed), [*true_plan, *twin], series_cols).where(phase == 0)
    wide = both.agg(
        F.count("*").alias("#n"),
        *[
            F.count_if(~F.col(f.name).eqNullSafe(F.col(f"{f.name}|changed"))).alias(f.name) for f in true_plan
        ],
    )
    declared = {f.name: f.nearest for f in true_plan}
    entries = F.array(*[
        F.struct(
            F.lit(n).alias("feature"), F.lit(lag).alias("declared_lag"),
            F.col("#n").alias("probes"), F.col(n).alias("changed"),
        )
        for n, lag in declared.items()
    ])
    return wide.select(F.inline(entries))


def undeclared(plan: Sequence[Feature]) -> list[str]:
    """Target features that do not claim to start at least one row back."""
    return [f.name for f in plan if "target" in f.tags and f.nearest < 1]


def leakage_audit(
    df: DataFrame,
    plan: Callable[[str], list[Feature]],
    extra: Sequence[str] = (),
    col: str = "y",
    series_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Features and their audit: causality, claimed lags and correlation.

    The audit has one row per feature; ``status`` is ``fail`` for any leak.
    """
    spec = plan(col)
    built = build(df, spec, series_cols)
    names = [*[f.name for f in spec], *extra]
    moved = {r["feature"]: r["changed"] for r in causality_audit(df, plan, col, series_cols).collect()}
    unclaimed = set(undeclared(spec))
    found = detect_leakage(built, names, col).collect()
    candidates = [r["feature"] for r in found if r["candidate"] and r["correlation"] is not None]
    probe = reconstruction_probe(built, candidates, col)
    rows = []
    for r in found:
        reasons = []
        if moved.get(r["feature"], 0):
            reasons.append("reads present or future")
        if r["feature"] in unclaimed:
            reasons.append("no lag declared")
        if r["candidate"]:
            reasons.append("correlation" if r["correlation"] is not None else "correlation unknown")
        status = "fail" if reasons else "pass"
        rows.append((r["feature"], r["correlation"], moved.get(r["feature"]), r["candidate"],
                     probe if r["feature"] in candidates else None, status, "; ".join(reasons)))
    schema = ("feature string, correlation double, changed bigint, candidate boolean, "
              "reconstruction_probe_r2 double, status string, reason string")
    return built, df.sparkSession.createDataFrame(rows, schema)


def write_audited(features: DataFrame, audit: DataFrame, path: str, audit_path: str) -> str:
    """Write the audit, and the features only when every one passed."""
    audit.write.json(audit_path)
    failed = [r["feature"] for r in audit.where("status = 'fail'").select("feature").collect()]
    if failed:
        raise RuntimeError(f"leakage detected, no features written: {', '.join(failed)}")
    return write_parquet(features, path)
