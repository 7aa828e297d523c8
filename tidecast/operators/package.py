"""Gates a run has to pass, and the facts of its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNUSABLE = ["leakage_suspected", "subpar", "subpar_after_expansion", "no_viable_candidate"]


def _finite(*cols: str):
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def validation_gates(
    cleaned: DataFrame, target: str, screening: DataFrame, ranking: DataFrame, noise_baseline: float | None,
    features: DataFrame, feature_names: Sequence[str], audit: DataFrame, holdout: DataFrame,
    candidates: DataFrame, selection: DataFrame,
) -> DataFrame:
    """One row per gate: step, gate, passed.  Each artifact is read once."""
    spark = cleaned.sparkSession
    found = {row["feature"]: row["status"] for row in screening.select("feature", "status").collect()}
    failed = audit.where("status <> 'pass'").count()
    models = candidates.where("status = 'ok'").agg(
        F.count("*").alias("n"), F.count_if(_finite("r2")).alias("r2"),
        F.count_if(_finite("r2", "rmse", "mae")).alias("all"), F.count("target_std").alias("stats"),
    ).first()
    chosen = selection.first()
    viable = chosen is not None and chosen["quality_flag"] not in ("no_viable_candidate", "leakage_suspected")
    dropped = [f for f, s in found.items() if s == "excluded"]
    gates = [
        ("10", "row_count_after", cleaned.limit(1).count() > 0),
        ("10", "target_column", target in cleaned.columns),
        ("11", "numeric_columns", len(found) > 0),
        ("11", "mi_ranking", ranking.limit(1).count() > 0),
        ("11", "recommended_features", "recommended" in found.values()),
        ("11", "noise_mi_baseline", noise_baseline is not None and abs(noise_baseline) < float("inf")),
        ("12", "features", len(feature_names) > 0 and set(feature_names) <= set(features.columns)),
        ("12", "features_table", features.limit(1).count() > 0),
        ("12", "leakage_audit", failed == 0),
        ("12", "excluded_stay_out", not set(dropped) & set(feature_names)),
        ("13", "holdout", holdout.limit(1).count() > 0),
        ("13", "finite_r2", models["r2"] > 0),
        ("14", "finite_metrics", models["n"] > 0 and models["all"] == models["n"]),
        ("14", "target_stats", models["stats"] == models["n"]),
        ("15", "quality_flag", chosen is not None and chosen["quality_flag"] is not None),
        ("15", "full_ranking", models["n"] > 0),
        ("15", "selected_model", not viable or chosen["selected_model"] is not None),
    ]
    return spark.createDataFrame(gates, "step string, gate string, passed boolean")


def result_package(selection: DataFrame, ranked: DataFrame, strongest: DataFrame, run: str = "run_id") -> DataFrame:
    """Winner, key metrics, strongest features, warning code and whether the run may be used.

    A leaked run shows no winner.
    """
    tops = strongest.groupBy(run).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]), ", ")
        .alias("strongest_features")
    )
    metrics = ranked.select(run, F.col("model").alias("selected_model"), "r2", "rmse", "mae")
    joined = selection.join(metrics, [run, "selected_model"], "left").join(tops, run, "left")
    unusable = F.col("quality_flag").isin(UNUSABLE)
    return joined.select(
        run, "selected_model", "weighted_score", "quality_flag", "r2", "rmse", "mae", "strongest_features",
        F.when(unusable, F.concat(F.lit("warn_"), F.col("quality_flag"))).alias("warning_code"),
        (~unusable).alias("production_usable"),
    )
