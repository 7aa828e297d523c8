"""Choose the production candidate of each run, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.metrics import grade
from tidecast.operators.training import COMPLEXITY

# Weights of the score.
WEIGHTS = {"r2": 0.50, "rmse": 0.25, "mae": 0.15, "stability": 0.10}
BELOW_MEAN = (
    "All candidates are below mean-baseline. Revisit feature engineering (step 12) or expand model classes "
    "(step 14 expansion)."
)


def stop_on_leakage(quality_assessment: str) -> None:
    if quality_assessment == "leakage_suspected":
        raise RuntimeError("leakage suspected: no model may be selected")


def eligible(candidates: DataFrame) -> DataFrame:
    """Candidates at least as good as the mean; the others are out of the race."""
    return candidates.withColumn("eligible", F.coalesce(F.col("r2") >= 0, F.lit(False)))


def _scaled(c: str, run: list[str]) -> Column:
    """Min-max over the eligible candidates of a run; 1 when they are all alike."""
    among = Window.partitionBy(*run, "eligible")
    lo, hi = F.min(c).over(among), F.max(c).over(among)
    return F.when(hi == lo, F.lit(1.0)).otherwise(F.try_divide(F.col(c) - lo, hi - lo))


def weighted_scores(candidates: DataFrame, run: str = "run_id") -> DataFrame:
    """Score of each eligible candidate; null for the rest.

    Runs hold a handful of candidates each, so the windows stay small.
    """
    marked = eligible(candidates)
    same = {c: F.min(c).over(Window.partitionBy(run, "eligible")) == F.max(c).over(Window.partitionBy(run, "eligible"))
            for c in ("rmse", "mae")}
    parts = marked.withColumns({
        "r2_norm": _scaled("r2", [run]),
        "rmse_norm": F.when(same["rmse"], 1.0).otherwise(1 - _scaled("rmse", [run])),
        "mae_norm": F.when(same["mae"], 1.0).otherwise(1 - _scaled("mae", [run])),
        "stability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("cv_std_r2", F.lit(1.0)))),
    })
    total = (
        WEIGHTS["r2"] * F.col("r2_norm") + WEIGHTS["rmse"] * F.col("rmse_norm")
        + WEIGHTS["mae"] * F.col("mae_norm") + WEIGHTS["stability"] * F.col("stability")
    )
    scored = parts.withColumn("weighted_score", F.when(F.col("eligible"), total))
    return scored.withColumns({
        c: F.when(F.col("eligible"), F.col(c)) for c in ("r2_norm", "rmse_norm", "mae_norm", "stability")
    })


def complexity(model: Column) -> Column:
    """Place in the order of complexity; unknown models come last."""
    place = F.lit(len(COMPLEXITY))
    for i, name in reversed(list(enumerate(COMPLEXITY))):
        place = F.when(model == name, F.lit(i)).otherwise(place)
    return place


def ranking(candidates: DataFrame, run: str = "run_id") -> DataFrame:
    """All candidates of each run, ineligible ones last; ties go to the simpler model."""
    order = Window.partitionBy(run).orderBy(
        F.col("eligible").desc(), F.round("weighted_score", 9).desc_nulls_last(),
        complexity(F.col("model")), "model",
    )
    return weighted_scores(candidates, run).withColumn("rank", F.row_number().over(order))


def quality_flag(best_r2: Column, eligible_count: Column, assessment: Column | None = None) -> Column:
    flag = F.when(F.coalesce(eligible_count, F.lit(0)) == 0, "no_viable_candidate").otherwise(grade(best_r2))
    if assessment is None:
        return flag
    return (
        F.when(assessment == "leakage_suspected", "leakage_suspected")
        .when((flag == "subpar") & (assessment == "subpar_after_expansion"), "subpar_after_expansion")
        .otherwise(flag)
    )


def select_best(candidates: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: winner, its score and the quality flag.

    ``runs`` lists the runs and may carry ``quality_assessment``.  A run
    without an eligible candidate keeps a null winner.
    """
    ranked = ranking(candidates, run)
    won = F.col("eligible") & (F.col("rank") == 1)
    best = ranked.groupBy(run).agg(
        F.max(F.when(won, F.col("model"))).alias("selected_model"),
        F.max(F.when(won, F.col("weighted_score"))).alias("weighted_score"),
        F.max("r2").alias("best_r2"), F.count_if("eligible").alias("eligible_candidates"),
    )
    joined = runs.join(best, run, "left")
    assessment = F.col("quality_assessment") if "quality_assessment" in runs.columns else None
    flag = quality_flag(F.col("best_r2"), F.col("eligible_candidates"), assessment)
    leaked = flag == "leakage_suspected"
    return joined.select(
        run,
        F.when(~leaked, F.col("selected_model")).alias("selected_model"),
        F.when(~leaked, F.col("weighted_score")).alias("weighted_score"),
        flag.alias("quality_flag"),
        F.when(flag == "no_viable_candidate", F.lit(BELOW_MEAN)).alias("message"),
    )


def candidate_analysis(candidates: DataFrame, naive: DataFrame, run: str = "run_id") -> DataFrame:
    """Why each candidate did well or poorly, in codes.

    The mean baseline has R2 0; the naive baseline comes from the run's
    persistence row.
    """
    base = naive.select(run, F.col("r2").alias("naive_r2"), F.col("rmse").alias("naive_rmse"))
    joined = candidates.join(base, run, "left")
    return joined.select(
        run, "model",
        F.col("r2").alias("delta_r2_vs_mean"),
        (F.col("r2") - F.col("naive_r2")).alias("delta_r2_vs_naive"),
        (F.col("rmse") - F.col("naive_rmse")).alias("delta_rmse_vs_naive"),
        F.try_divide(F.col("rmse"), F.col("target_std")).alias("rmse_over_std"),
        F.when(F.col("cv_std_r2").isNull(), "unknown").when(F.col("cv_std_r2") <= 0.1, "stable")
        .when(F.col("cv_std_r2") <= 0.3, "varying").otherwise("unstable").alias("stability_code"),
        F.when(F.col("r2") < 0, "worse_than_mean").when(F.col("r2") < F.col("naive_r2"), "worse_than_naive")
        .when(F.col("r2") >= 0.5, "captures_signal").otherwise("weak_signal").alias("reason_code"),
    )
