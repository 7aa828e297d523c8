"""A whole run: screen, profile, build features, audit, train, evaluate, select, report.

Rows are worked on by Spark throughout.  The driver sees tables whose size
depends on the number of columns, lags, folds or models only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators import (
    benchmarks, evaluation, features as fx, leakage, metrics, package, periods, profile, screening,
    seasonality, selection, split, stattests, training,
)
from tidecast.operators.order import join_keys, over_order, without_nulls
from tidecast.storage import scratch_path, written_table


def noise_flags(df: DataFrame, col: str, series_cols: Sequence[str] = (), lags: int = 10) -> DataFrame:
    """``white_noise`` levels, or a ``random_walk``: not stationary, white once differenced."""
    keys = list(series_cols)
    level = stattests.ljung_box(stattests.acf(df, col, lags, keys), lags, keys)
    stepped = over_order(
        df.select(*keys, "t_idx", F.col(col).alias("y")),
        lambda w: {"step": F.col("y") - F.lag("y", 1).over(w)}, behind=1, series_cols=keys,
    )
    steps = stattests.ljung_box(stattests.acf(stepped, "step", lags, keys), lags, keys)
    unit_root = stattests.adf(df, col, series_cols=keys)
    one = F.lit(1).alias("_one")
    parts = [
        level.select(*keys, one, "white_noise"),
        steps.select(*keys, one, F.col("white_noise").alias("white_steps")),
        unit_root.select(*keys, one, "stationary"),
    ]
    joined = join_keys(join_keys(parts[0], parts[1], [*keys, "_one"], "left"), parts[2], [*keys, "_one"], "left")
    return joined.select(
        *keys, "stationary", "white_noise",
        (~F.col("stationary") & F.col("white_steps")).alias("random_walk"),
    )


def series_profile(df: DataFrame, col: str = "y", usual: Sequence[int] = (7, 12, 24), found: int = 3) -> dict:
    """Flags, step, periods and significant lags of one series.

    The periods tried are the usual ones and the strongest that the series
    shows by itself.  Series under 50 rows keep unknown test results and a
    warning.
    """
    n = (df.agg(F.max("t_idx")).first()[0] or 0) + 1
    out = {"rows": n, "warnings": [], "multiple_series": False}
    step = profile.step_seconds(df).first()
    out["step_seconds"] = step["step_seconds"] if step else None
    if n < stattests.SMALL_SERIES:
        out |= {"stationary": None, "white_noise": None, "random_walk": None, "trend_detected": None,
                "seasonality_detected": None, "significant_lags": [1], "period": None}
        out["warnings"].append(f"only {n} rows: tests skipped")
        return out
    out |= noise_flags(df, col).first().asDict()
    shown = [r["period"] for r in periods.find_periods(df, col).where(F.col("rank") <= found).collect()]
    usable = sorted({p for p in (*usual, *shown) if 3 * p < n}) or [2]
    strength = seasonality.detect_seasonality(df, col, usable)
    out |= seasonality.component_flags(strength).first().asDict()
    out["period"], out["found_periods"] = strength.where("dominant").first()["period"], shown
    curve = stattests.acf(df, col, 24)
    out["significant_lags"] = sorted(r["lag"] for r in stattests.significant_lags(curve).collect())
    return out


@dataclass
class Run:
    """Tables and models of one run."""

    run_id: str
    profile: dict
    screening: screening.Screening
    feature_names: list[str]
    features: DataFrame
    audit: DataFrame
    trained: training.Trained
    benchmarks: DataFrame
    candidates: DataFrame
    ranking: DataFrame
    selection: DataFrame
    gates: DataFrame


def forecast_run(
    df: DataFrame,
    target: str = "y",
    sources: Sequence[str] = (),
    candidates: Sequence[str] | None = None,
    folds: int = split.FOLDS,
    search: bool = True,
    lags: Sequence[int] = (1, 2, 3, 7),
    windows: Sequence[int] = (7,),
    split_mode: str = "auto",
    run_id: str | None = None,
) -> Run:
    """Run every stage for one ordered series ``(t, t_idx, target, sources)``.

    Source columns enter the features one row late, so nothing from the row
    being predicted is used.  A leak in the features raises before anything is
    trained, and one that scores too good to be true give away raises before
    anything is selected.  Poor scores lead to more candidates, on features that
    half the noise baseline lets through.
    """
    spark = df.sparkSession
    split.resolve_split_mode(split_mode, "t_idx" in df.columns)
    run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    rows = df.withColumnRenamed(target, "y") if target != "y" else df
    rows = without_nulls(rows, "y").drop("_was")
    facts = series_profile(rows)

    found = screening.screen_features(rows, "y", F.col("t_idx"), list(sources)) if sources else screening.Screening(
        [], [], {}, 0.0, False, [])
    steps = sorted({*lags, *facts["significant_lags"]})

    def plan(col: str, used: Sequence[str] = tuple(found.recommended)) -> list[fx.Feature]:
        out = [*fx.lag_features(col, steps), *fx.rolling_features(col, windows), *fx.differencing_features(col, (1,))]
        if facts.get("seasonality_detected") and facts.get("period"):
            out += fx.fourier_features(facts["period"])
        for s in used:
            out += fx.lag_features(s, [1], s, "source")
        return out

    def audited(plan) -> tuple[list[str], DataFrame, DataFrame]:
        names = [f.name for f in plan("y")]
        fx.validate_feature_count(names)
        built, audit = leakage.leakage_audit(rows, plan)
        kept, _ = fx.drop_warm_up(built, max(f.farthest for f in plan("y")))
        kept = kept.na.fill(0.0, subset=[n for n in names if "pct_change" in n])
        path = scratch_path(spark, "features")
        leakage.write_audited(kept.select("t_idx", "y", *names), audit, path, scratch_path(spark, "audit"))
        return names, audit, spark.read.parquet(path)

    names, audit, table = audited(plan)

    n = facts["rows"]
    first = floor((1 - split.HOLDOUT_SHARE) * n)
    train, holdout = table.where(F.col("t_idx") < first), table.where(F.col("t_idx") >= first)
    menu = list(candidates or ["ridge", "gradient_boosting", "random_forest"])
    done = training.train_candidates(train, holdout, names, menu, split.expanding_folds(first)[-folds:], search)

    bench = _benchmarks(rows, train, holdout, facts, first)
    scored = done.table(spark).withColumn("run_id", F.lit(run_id))
    best = max((r[4] for r in done.results if r[4] is not None), default=None)
    assessment = "acceptable"
    if best is not None and best > metrics.TOO_PERFECT:
        _, leaked = evaluation.stress_test(train, holdout, names, plan("y"), best_r2=best)
        selection.stop_on_leakage("leakage_suspected" if leaked else assessment)
    elif best is not None and best < metrics.MARGINAL and candidates is None:
        wider = screening.relaxed_screening(rows, found) if sources else found
        if wider.recommended != found.recommended:
            # What half the noise baseline lets through enters a second table of features.
            names, audit, table = audited(lambda col: plan(col, wider.recommended))
            train, holdout, found = table.where(F.col("t_idx") < first), table.where(F.col("t_idx") >= first), wider
        done, assessment = evaluation.expansion_round(
            done, train, holdout, names, split.expanding_folds(first)[-folds:], names, search)
        scored = done.table(spark).withColumn("run_id", F.lit(run_id))
    scored = metrics.benchmark_deltas(scored, bench)
    ranked = selection.ranking(scored.where("status = 'ok'"))
    runs = spark.createDataFrame([(run_id, assessment)], "run_id string, quality_assessment string")
    chosen = selection.select_best(scored.where("status = 'ok'"), runs)
    mi = spark.createDataFrame([(f, v) for f, v in found.mi.items()] or [("", 0.0)], "feature string, mi double")
    gates = package.validation_gates(
        rows, "y", found.table(rows), mi, found.noise_baseline, table, names, audit, holdout, scored, chosen)
    return Run(run_id, facts, found, names, table, audit, done, bench, scored, ranked, chosen, gates)


def _benchmarks(rows: DataFrame, train: DataFrame, holdout: DataFrame, facts: dict, first: int) -> DataFrame:
    """Persistence, ARIMA and k-means on the same holdout rows."""
    held = F.col("t_idx") >= first
    naive = benchmarks.persistence(rows).where(held)
    d = 1 if facts.get("stationary") is False else 0
    arima, _ = benchmarks.arima(rows, F.col("t_idx") < first, d)
    lag_names = [c for c in train.columns if c.startswith("y_lag_")]
    means, _ = benchmarks.kmeans_benchmark(train, holdout, lag_names)
    scored = None
    for name, part in (("naive_persistence", naive), ("arima_benchmark", arima.where(held)), ("kmeans_benchmark", means)):
        one = part.select(F.lit(name).alias("model"), "y", "prediction")
        scored = one if scored is None else scored.unionByName(one)
    # Three rows; worked out once for all their uses.
    return written_table(metrics.evaluate(scored), "benchmarks")


def daily_revenue_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Rank ridge regression and persistence for daily revenue."""
    from tidecast.plans.inputs import daily_revenue

    days = daily_revenue(spark, sf)
    plan = [*fx.lag_features("y", [1, 7]), *fx.rolling_features("y", [7]), *fx.calendar_features()]
    names = [f.name for f in plan]
    rows, _ = fx.drop_warm_up(fx.build(days, plan), 7)
    rows = written_table(rows.select("t_idx", "y", *names), "features")
    train, holdout = split.chronological(rows)
    folds = split.expanding_folds(train.agg(F.max("t_idx")).first()[0] + 1)
    done = training.train_candidates(train, holdout, names, ["ridge"], folds, search=False)
    ridge = done.table(spark).select("model", "r2", "rmse", "mae", "cv_std_r2")
    naive_rows = split.test_folds(benchmarks.persistence(days))
    naive_folds = metrics.evaluate(naive_rows.where("fold is not null"), ["fold"])
    spread = naive_folds.agg(F.stddev_samp("r2")).first()[0]
    naive = metrics.evaluate(naive_rows.where("is_holdout"), ()).select(
        F.lit("naive_persistence").alias("model"), "r2", "rmse", "mae", F.lit(spread).cast("double").alias("cv_std_r2"))
    both = ridge.unionByName(naive).withColumn("run_id", F.lit("daily_revenue"))
    return selection.ranking(both).select(
        "run_id", "model", "eligible", "r2", "rmse", "mae", "weighted_score", "rank")
