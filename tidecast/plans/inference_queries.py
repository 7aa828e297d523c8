"""Scoring, forecasts, explanations and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import features as fx, inference, metrics, package, runs, selection, split, training, trees
from tidecast.operators.order import dense_index, join_keys
from tidecast.plans.inputs import EV, PANEL, SEAS, event_panel, event_series, r, rounded, table
from tidecast.plans.model_queries import (
    FEATURES, HOLD, RUNS, _FLAGS, _SCORED, _runs, candidates, parts, run_metrics,
)
from tidecast.plans.registry import query
from tidecast.storage import scratch_path

# A linear model with given weights: everything about it can be checked in SQL.
NAMES, WEIGHTS, INTERCEPT = ["y_lag_1", "y_lag_2", "x_lag_1"], [0.5, 0.2, 0.1], 7.0
_ROWS = f"""{EV}, rows_ AS (SELECT event_id, t_idx, y, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2,
    lag(x, 1) OVER w AS x_lag_1 FROM ev WINDOW w AS (ORDER BY t_idx)),
  hold AS (SELECT *, 7.0 + 0.5 * y_lag_1 + 0.2 * y_lag_2 + 0.1 * x_lag_1 AS prediction FROM rows_
    WHERE t_idx >= {HOLD.format(src="ev")})"""


def scored_holdout(spark, sf):
    plan = [*fx.lag_features("y", [1, 2]), *fx.lag_features("x", [1], "x", "source")]
    _, holdout = split.chronological(fx.build(event_series(spark, sf), plan))
    scored = holdout.withColumn("prediction", inference.dot(WEIGHTS, NAMES, INTERCEPT))
    return inference.with_residuals(scored)


@query("g1_batch_scoring", f"WITH {_ROWS} SELECT event_id, y, {r('prediction')} AS prediction, {r('y - prediction')} AS residual FROM hold")
def batch_scoring(spark, sf):
    scored = scored_holdout(spark, sf)
    return scored.select("event_id", "y", rounded("prediction").alias("prediction"), rounded("residual").alias("residual"))


@query("g1_model_scoring")
def model_scoring(spark, sf):
    train, holdout, _ = parts(spark, sf)
    model = training.fit(training.CANDIDATES["ridge"], train, FEATURES, {"regParam": 0.1})
    scored = inference.score_rows(model, holdout)
    return scored.select("event_id", "y", rounded("prediction").alias("prediction"), rounded("residual").alias("residual"))


_STEPS = f"""WITH RECURSIVE {PANEL}, tails AS (SELECT event_type, max_by(y, t_idx) AS a,
    max_by(y, CASE WHEN t_idx < n - 1 THEN t_idx END) AS b, max_by(y, CASE WHEN t_idx < n - 2 THEN t_idx END) AS c
    FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM panel) GROUP BY 1),
  f(event_type, step, a, b, c) AS (SELECT event_type, 0, a, b, c FROM tails
    UNION ALL SELECT event_type, step + 1, 10.0 + 0.5::DOUBLE * a + 0.3::DOUBLE * c, a, b FROM f WHERE step < 100)"""


@query("g2_forecast_linear", f"{_STEPS} SELECT event_type, step, {r('a')} AS forecasted_value FROM f WHERE step > 0")
def forecast_linear(spark, sf):
    tails = inference.last_values(event_panel(spark, sf), 3, "y", ["event_type"])
    out = inference.forecast_linear_lags(tails, [1, 3], [0.5, 0.3], 10.0, 100, ["event_type"])
    return out.select("event_type", "step", rounded("forecasted_value").alias("forecasted_value"))


@query("g2_forecast_roll", f"""WITH RECURSIVE {PANEL}, last AS (SELECT event_type, max_by([a, b, y], t_idx) AS x FROM (
    SELECT *, lag(y, 2) OVER w AS a, lag(y, 1) OVER w AS b FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY t_idx)) GROUP BY 1),
  f(event_type, step, x) AS (SELECT event_type, 0, x FROM last
    UNION ALL SELECT event_type, step + 1, [x[2], x[3], 5.0 + 0.2::DOUBLE * x[1] + 0.3::DOUBLE * x[2] + 0.4::DOUBLE * x[3]] FROM f WHERE step < 25)
  SELECT event_type, step, {r("x[3]")} AS forecasted_value FROM f WHERE step > 0""")
def forecast_roll(spark, sf):
    last = inference.last_values(event_panel(spark, sf), 3, "y", ["event_type"]).withColumnRenamed("tail", "x")
    out = inference.forecast_linear_roll(last, [0.2, 0.3, 0.4], 5.0, 25, ["event_type"])
    return out.select("event_type", "step", rounded("forecasted_value").alias("forecasted_value"))


@query("g2_forecast_with_sources", """WITH RECURSIVE panel AS (SELECT event_type, value AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t_idx FROM events),
  ends AS (SELECT event_type, max(t_idx) AS e FROM panel GROUP BY 1),
  ahead AS (SELECT p.event_type, t_idx - e + 40 AS step, x FROM panel p JOIN ends USING (event_type) WHERE t_idx - e + 40 BETWEEN 1 AND 8),
  last AS (SELECT p.event_type, list(y ORDER BY t_idx) AS ys, max_by(x, t_idx) AS x FROM panel p JOIN ends USING (event_type)
    WHERE t_idx > e - 3 GROUP BY 1),
  f(event_type, step, ys, x) AS (SELECT event_type, 0::BIGINT, ys, x FROM last
    UNION ALL SELECT f.event_type, f.step + 1, [ys[2], ys[3], 1.0::DOUBLE + 0.4::DOUBLE * ys[3] + 0.2::DOUBLE * ys[1] + 0.5::DOUBLE * f.x],
      coalesce(a.x, f.x) FROM f LEFT JOIN ahead a ON a.event_type = f.event_type AND a.step = f.step + 1 WHERE f.step < 12)
  SELECT event_type, CAST(step AS INTEGER) AS step, """ + r("ys[3]") + """ AS forecasted_value FROM f WHERE step > 0""")
def forecast_with_sources(spark, sf):
    """12 steps of a linear model that also sees a source: known for 8 steps, then kept."""
    events = table(spark, sf, "events").select(
        "event_type", "event_id", F.col("ts").alias("t"), F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("x"))
    panel = dense_index(events, ["t", "event_id"], ["event_type"])
    ends = panel.groupBy("event_type").agg(F.max("t_idx").alias("e"))
    step = F.col("t_idx") - F.col("e") + 40
    ahead = join_keys(panel, ends, ["event_type"]).where(step.between(1, 8)).select("event_type", step.alias("step"), "x")
    plan = [*fx.lag_features("y", [1, 3]), *fx.lag_features("x", [1], "x", "source")]
    model = inference.FixedLinear(("y_lag_1", "y_lag_3", "x_lag_1"), (0.4, 0.2, 0.5), 1.0)
    out = inference.forecast_recursive(model, panel, plan, 12, 3600, ["event_type"], ["x"], ahead)
    return out.select("event_type", "step", rounded("forecasted_value").alias("forecasted_value"))


@query("g2_forecast_forest")
def forecast_forest(spark, sf):
    """Twelve steps of a forest with lags and rolling means rebuilt at every step, all series at once."""
    panel = event_panel(spark, sf)
    plan = [*fx.lag_features("y", [1, 2]), *fx.rolling_features("y", [7])]
    names = [f.name for f in plan]
    rows, _ = fx.drop_warm_up(fx.build(panel, plan, ["event_type"]), 7)
    train, _ = split.chronological(rows, ["event_type"])
    model = training.fit(training.CANDIDATES["random_forest"], train, names, {"maxDepth": 5, "numTrees": 10})
    return inference.forecast_recursive(model, panel, plan, 12, 3600, ["event_type"])


@query("g2_forecast_forest_roll")
def forecast_forest_roll(spark, sf):
    train, holdout, _ = parts(spark, sf)
    names = ["y_lag_3", "y_lag_2", "y_lag_1"]
    model = training.fit(training.CANDIDATES["random_forest"], train, names, {"maxDepth": 5, "numTrees": 10})
    return inference.forecast_roll(model, inference.last_values(holdout, 3).select(
        *[F.get("tail", i).alias(n) for i, n in enumerate(names)]), names, 12)


@query("g3_forecast_summary", f"""{_STEPS}, h AS (SELECT avg(y) AS m FROM panel)
  SELECT count(*) AS forecast_length, {r("avg(a)")} AS forecast_mean, {r("max(a) - min(a)")} AS forecast_range,
    {r("avg(a) - any_value(m)")} AS vs_historical_mean FROM f, h WHERE step > 0""")
def forecast_summary(spark, sf):
    panel = event_panel(spark, sf)
    tails = inference.last_values(panel, 3, "y", ["event_type"])
    forecast = inference.forecast_linear_lags(tails, [1, 3], [0.5, 0.3], 10.0, 100, ["event_type"])
    out = inference.forecast_summary(forecast, panel.agg(F.avg("y")).first()[0])
    return out.select("forecast_length", *[rounded(c).alias(c) for c in out.columns[1:]])


@query("g4_coefficients")
def coefficients(spark, sf):
    train, _, _ = parts(spark, sf)
    ridge = training.fit(training.CANDIDATES["ridge"], train, FEATURES, {"regParam": 0.1})
    trees = training.fit(training.CANDIDATES["random_forest"], train, FEATURES, {"maxDepth": 5, "numTrees": 10})
    both = inference.importance(ridge, FEATURES, spark).unionByName(inference.importance(trees, FEATURES, spark))
    return both.withColumn("value", rounded("value"))


_SHAP = f"""{_ROWS}, sample AS (SELECT * FROM hold ORDER BY t_idx LIMIT 100),
  base AS (SELECT avg(y_lag_1) AS a, avg(y_lag_2) AS b, avg(x_lag_1) AS c FROM (SELECT * FROM sample ORDER BY t_idx LIMIT 20)),
  shap AS (SELECT t_idx AS row_id, unnest(['y_lag_1', 'y_lag_2', 'x_lag_1']) AS feature,
    unnest([y_lag_1, y_lag_2, x_lag_1]) AS value,
    unnest([0.5 * (y_lag_1 - a), 0.2 * (y_lag_2 - b), 0.1 * (x_lag_1 - c)]) AS shap FROM sample, base)"""


def _attributions(spark, sf):
    sample = inference.first_rows(scored_holdout(spark, sf), 100)
    return inference.linear_attributions(sample, NAMES, WEIGHTS, inference.first_rows(sample, 20))


@query("g5_linear_attributions", f"WITH {_SHAP} SELECT row_id, feature, value, {r('shap')} AS shap FROM shap")
def linear_attributions(spark, sf):
    return _attributions(spark, sf).withColumn("shap", rounded("shap"))


@query("g5_attributions_all_rows", f"""WITH {_ROWS}, base AS (SELECT avg(y_lag_1) AS a, avg(y_lag_2) AS b, avg(x_lag_1) AS c FROM hold)
  SELECT t_idx AS row_id, unnest(['y_lag_1', 'y_lag_2', 'x_lag_1']) AS feature, unnest([y_lag_1, y_lag_2, x_lag_1]) AS value,
    unnest([{r("0.5 * (y_lag_1 - a)", 8)}, {r("0.2 * (y_lag_2 - b)", 8)}, {r("0.1 * (x_lag_1 - c)", 8)}]) AS shap FROM hold, base""")
def attributions_all_rows(spark, sf):
    """A linear model needs no sample: every holdout row against the whole background."""
    scored = scored_holdout(spark, sf)
    return inference.linear_attributions(scored, NAMES, WEIGHTS, scored).withColumn("shap", rounded("shap", 8))


@query("g5_sampled_attributions")
def sampled_attributions(spark, sf):
    """Attributions of a forest; per row they add up to its distance from the background."""
    train, holdout, _ = parts(spark, sf)
    names = ["y_lag_1", "y_lag_7", "sin_1", "cos_1"]
    model = training.fit(training.CANDIDATES["random_forest"], train, names, {"maxDepth": 5, "numTrees": 10})
    sample = inference.first_rows(holdout, 100)
    found = inference.sampled_attributions(model, sample, names, inference.first_rows(sample, 20))
    return found.withColumn("shap", rounded("shap"))


_TREE_NAMES = ["y_lag_1", "y_lag_7", "sin_1", "cos_1"]


def _explained(spark, sf, family, params):
    train, holdout, _ = parts(spark, sf)
    model = training.fit(training.CANDIDATES[family], train, _TREE_NAMES, params)
    return model, holdout, trees.tree_attributions(model, holdout, _TREE_NAMES)


@query("g5_tree_attributions")
def tree_attributions(spark, sf):
    """Exact attributions of a forest for every holdout row."""
    _, _, found = _explained(spark, sf, "random_forest", {"maxDepth": 5, "numTrees": 10})
    return found.withColumn("shap", rounded("shap"))


@query("g5_tree_attributions_add_up", f"""WITH {SEAS}, w AS (SELECT * FROM (SELECT t_idx, row_number() OVER (ORDER BY t_idx) - 1 AS i,
    lag(y, 1) OVER (ORDER BY t_idx) AS y_lag_1, lag(y, 7) OVER (ORDER BY t_idx) AS y_lag_7 FROM seas) WHERE t_idx >= 14),
  h AS (SELECT * FROM w WHERE t_idx >= (SELECT floor(0.8 * (max(t_idx) + 1)) FROM w))
  SELECT family, count(*) AS rows_explained, {r("avg(y_lag_1)")} AS mean_lag_1, {r("avg(y_lag_7)")} AS mean_lag_7, 0::BIGINT AS rows_off
  FROM h, (SELECT unnest(['random_forest', 'gradient_boosting']) AS family) GROUP BY family""")
def tree_attributions_add_up(spark, sf):
    """Per row the attributions and the base value give the prediction."""
    out = None
    for family, params in (("random_forest", {"maxDepth": 5, "numTrees": 10}), ("gradient_boosting", {"maxDepth": 3, "maxIter": 5, "stepSize": 0.2})):
        model, holdout, found = _explained(spark, sf, family, params)
        base = trees.base_value(trees.leaves(model))
        summed = found.groupBy("row_id").agg(F.sum("shap").alias("shap"), *[
            F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in ("y_lag_1", "y_lag_7")])
        both = model.transform(holdout).select(F.col("t_idx").alias("row_id"), "prediction").join(summed, "row_id", "left")
        off = F.abs(F.col("prediction") - F.col("shap") - F.lit(base)) > 1e-9
        one = both.agg(F.count("*").alias("rows_explained"), rounded(F.avg("y_lag_1")).alias("mean_lag_1"),
                       rounded(F.avg("y_lag_7")).alias("mean_lag_7"), F.count_if(F.coalesce(off, F.lit(True))).alias("rows_off"))
        one = one.withColumn("family", F.lit(family))
        out = one if out is None else out.unionByName(one)
    return out


@query("g6_attribution_ranking", f"""WITH {_SHAP} SELECT feature, {r("avg(abs(shap))")} AS mean_shap FROM shap GROUP BY feature
  ORDER BY mean_shap DESC LIMIT 15""")
def attribution_ranking(spark, sf):
    return inference.attribution_ranking(_attributions(spark, sf)).withColumn("mean_shap", rounded("mean_shap"))


@query("g6_attribution_summary", f"""WITH {_SHAP}, p AS (SELECT feature, avg(abs(shap)) AS m FROM shap GROUP BY feature)
  SELECT {r("avg(m)")} AS overall_mean, {r("max(m)")} AS overall_max, max_by(feature, m) AS most_important FROM p""")
def attribution_summary(spark, sf):
    found = inference.attribution_summary(_attributions(spark, sf))
    return found.withColumns({c: rounded(c) for c in ("overall_mean", "overall_max")})


@query("g7_single_prediction", f"""WITH {_SHAP} SELECT feature, value, {r("shap")} AS shap, {r("abs(shap)")} AS abs_shap FROM shap
  WHERE row_id = (SELECT min(row_id) FROM shap) ORDER BY abs(shap) DESC LIMIT 15""")
def single_prediction(spark, sf):
    shap = _attributions(spark, sf)
    row = shap.agg(F.min("row_id")).first()[0]
    return inference.contributions(shap, row).withColumns({c: rounded(c) for c in ("shap", "abs_shap")})


@query("g8_feature_statistics", f"""WITH {_ROWS} {" UNION ALL ".join(f'''SELECT '{c}' AS feature, {r(f"avg({c})")} AS mean,
  {r(f"stddev_pop({c})")} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM hold''' for c in NAMES)}""")
def feature_statistics(spark, sf):
    found = inference.feature_statistics(scored_holdout(spark, sf), NAMES)
    return found.withColumns({c: rounded(c) for c in ("mean", "std")})


@query("g9_residual_histogram", f"""WITH {_ROWS}, e AS (SELECT y - prediction AS e FROM hold),
  b AS (SELECT min(e) AS lo, (max(e) - min(e)) / 30 AS w FROM e)
  SELECT CAST(least(floor((e - lo) / w), 29) AS INTEGER) AS bin,
    {r("any_value(lo) + least(floor((e - lo) / w), 29) * any_value(w)")} AS low,
    {r("any_value(lo) + (least(floor((e - lo) / w), 29) + 1) * any_value(w)")} AS high, count(*) AS residuals
  FROM e, b GROUP BY least(floor((e - lo) / w), 29)""")
def residual_histogram(spark, sf):
    found = metrics.residual_histogram(scored_holdout(spark, sf))
    return found.withColumns({c: rounded(c) for c in ("low", "high")})


@query("g11_comparison_table", f"""WITH {RUNS}, c AS (SELECT model, r2, rmse, mae FROM m WHERE run_id = 'click wave'),
  k AS (SELECT *, model = 'naive_persistence' AS is_benchmark FROM c
    UNION ALL SELECT 'arima_benchmark', r2, rmse, mae, true FROM m WHERE run_id = 'view wave' AND model = 'ridge')
  SELECT model, {r("r2")} AS r2, {r("rmse")} AS rmse, {r("mae")} AS mae, is_benchmark,
    model = (SELECT max_by(model, r2) FROM k WHERE NOT is_benchmark) AS is_best,
    CAST(row_number() OVER (ORDER BY is_benchmark DESC, CASE WHEN is_benchmark THEN model END, r2) AS INTEGER) AS position FROM k""")
def comparison_table(spark, sf):
    found = run_metrics(spark, sf)
    listed = found.where("run_id = 'click wave'").select("model", "r2", "rmse", "mae")
    other = found.where("run_id = 'view wave' and model = 'ridge'").select(
        F.lit("arima_benchmark").alias("model"), F.col("r2").alias("holdout_r2"),
        F.col("rmse").alias("holdout_rmse"), F.col("mae").alias("holdout_mae"),
    )
    repeated = other.withColumn("model", F.lit("naive_persistence"))
    merged = inference.comparison_table(listed, other.unionByName(repeated))
    return merged.withColumns({c: rounded(c) for c in ("r2", "rmse", "mae")})


@query("g12_run_catalogue", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS records FROM events "
       "GROUP BY 1 HAVING max(value) > 250 ORDER BY 1 DESC")
def run_catalogue(spark, sf):
    """One run per day; a run has a model when its largest value is above 250."""
    runs = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("run_id")).agg(
        F.count("*").alias("records"), (F.max("value") > 250).alias("has_model")
    )
    return inference.run_catalogue(runs).drop("has_model")


@query("g13_validation_gates", """SELECT step, gate, true AS passed FROM (VALUES
  ('10', 'row_count_after'), ('10', 'target_column'), ('11', 'numeric_columns'), ('11', 'mi_ranking'),
  ('11', 'recommended_features'), ('11', 'noise_mi_baseline'), ('12', 'features'), ('12', 'features_table'),
  ('12', 'leakage_audit'), ('12', 'excluded_stay_out'), ('13', 'holdout'), ('13', 'finite_r2'), ('14', 'finite_metrics'),
  ('14', 'target_stats'), ('15', 'quality_flag'), ('15', 'full_ranking'), ('15', 'selected_model')) v(step, gate),
  (SELECT count(*) FROM events)""")
def validation_gates(spark, sf):
    """The gates of one whole run over the wave series."""
    from tidecast.plans.forecast import forecast_run
    from tidecast.plans.inputs import seasonal_series

    run = forecast_run(
        seasonal_series(spark, sf).select("t", "t_idx", "event_id", "x", "y"), "y", sources=["x"],
        candidates=["ridge"], folds=2, search=False,
    )
    return run.gates


@query("g14_result_package", f"""WITH {_SCORED}, {_FLAGS} SELECT run_id,
    CASE WHEN quality_flag <> 'leakage_suspected' THEN fl.model END AS selected_model, quality_flag,
    CASE WHEN quality_flag <> 'leakage_suspected' THEN {r("m.r2")} END AS r2, 'y_lag_7, y_lag_1' AS strongest_features,
    CASE WHEN quality_flag NOT IN ('acceptable', 'marginal') THEN 'warn_' || quality_flag END AS warning_code,
    quality_flag IN ('acceptable', 'marginal') AS production_usable
  FROM fl LEFT JOIN m USING (run_id, model)""")
def result_package(spark, sf):
    found = candidates(spark, sf)
    chosen = selection.select_best(found, _runs(spark, sf))
    strongest = chosen.select("run_id", F.inline(F.array(
        F.struct(F.lit(2).alias("rank"), F.lit("y_lag_1").alias("feature")),
        F.struct(F.lit(1).alias("rank"), F.lit("y_lag_7").alias("feature")),
    )))
    facts = package.result_package(chosen, selection.ranking(found), strongest)
    return facts.select("run_id", "selected_model", "quality_flag", rounded("r2").alias("r2"), "strongest_features",
                        "warning_code", "production_usable")


@query("g12_stored_runs", """WITH counts AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice >= 20000) AS a,
    count(*) FILTER (o_totalprice >= 20000 AND o_orderstatus != 'P') AS b FROM orders)
  SELECT 'wave-2' AS run_id, 2::BIGINT AS place, 'small orders' AS stage, 'price below 20000' AS reason, n AS rows_in, a AS rows_out, b AS stored_rows FROM counts
  UNION ALL SELECT 'wave-2', 2, 'pending', 'status P', a, b, b FROM counts
  UNION ALL SELECT 'wave-1', 1, 'small orders', 'price below 20000', n, a, a FROM counts""")
def stored_runs(spark, sf):
    """Three runs store tables, one of them breaks off before its end; the catalogue and the row logs of the others."""
    folder, orders = scratch_path(spark, "runs"), table(spark, sf, "orders")

    def run(run_id: str, pending: bool, breaks: bool) -> None:
        r_ = runs.StoredRun(spark, folder, run_id)
        kept = r_.keep(orders, "small orders", F.col("o_totalprice") >= 20000, "price below 20000")
        if pending:
            kept = r_.keep(kept, "pending", F.col("o_orderstatus") != "P", "status P")
        r_.store("cleaned", kept)
        if breaks:
            raise RuntimeError("lost before its end")
        r_.finish(model="ridge")

    run("wave-1", False, False)
    run("wave-2", True, False)
    try:
        run("wave-3", True, True)
    except RuntimeError:
        pass
    out = None
    listed = [x["run_id"] for x in runs.stored_runs(spark, folder).collect()]  # a few runs
    for place, run_id in enumerate(reversed(listed), 1):
        stored = runs.load_table(spark, folder, run_id, "cleaned").count()
        log = runs.load_table(spark, folder, run_id, "row_log").withColumn("stored_rows", F.lit(stored).cast("long"))
        one = log.select(F.lit(run_id).alias("run_id"), F.lit(place).cast("long").alias("place"), "stage", "reason", "rows_in", "rows_out", "stored_rows")
        out = one if out is None else out.unionByName(one)
    return out
