"""Feature engineering and leakage."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tidecast.operators import features as fx
from tidecast.operators import information, leakage, periods, profile, scaling, seasonality, split, stattests
from tidecast.plans.explore_queries import _edges, _mi, acf_sql, phase_sql
from tidecast.plans.inputs import (
    EV, PANEL, SEAS, event_panel, event_series, r, rounded, seasonal_series, table,
)
from tidecast.plans.registry import query


def _lag(k: int, y: str = "y") -> str:
    return f"lag({y}, {k}) OVER (ORDER BY t_idx)"


@query("c1_target_detection", f"""WITH {EV}, v AS (SELECT 'y' AS "column", var_samp(y) AS s FROM ev
    UNION ALL SELECT 'x', var_samp(x) FROM ev)
  SELECT "column", 'highest_variance' AS method, {r("s")} AS score, s = (SELECT max(s) FROM v) AS chosen FROM v""")
def target_detection(spark, sf):
    series = event_series(spark, sf).withColumn("flat", F.lit(1.0))
    _, info = profile.detect_target(series, ["x", "y", "flat"])
    return info.withColumn("score", rounded("score"))


@query("c1_target_by_self_correlation", f"""WITH {SEAS}, v AS (
    SELECT 'y' AS "column", corr(y, b) AS s FROM (SELECT y, {_lag(1)} AS b FROM seas)
    UNION ALL SELECT 'x', corr(x, b) FROM (SELECT x, {_lag(1, "x")} AS b FROM seas))
  SELECT "column", 'most_correlated_with_self' AS method, {r("s")} AS score,
         s = (SELECT max(s) FROM v) AS chosen FROM v""")
def target_by_self(spark, sf):
    _, info = profile.detect_target(seasonal_series(spark, sf), ["x", "y"], "most_correlated_with_self")
    return info.withColumn("score", rounded("score"))


def _lag_mi(src: str, lags: int) -> str:
    return f"""b AS (SELECT t_idx, len(list_filter(list_distinct({_edges("y", src)}), lambda e: y > e)) AS bin FROM {src}),
    lagged AS (SELECT bin AS ybin, {", ".join(f"{_lag(k, 'bin')} AS b{k}" for k in range(1, lags + 1))} FROM b),
    mi AS {_mi(f'''SELECT * FROM (SELECT ybin, CAST(unnest(range(1, {lags + 1})) AS INTEGER) AS lag,
      unnest([{", ".join(f"b{k}" for k in range(1, lags + 1))}]) AS xbin FROM lagged) WHERE xbin IS NOT NULL''', "lag")}"""


@query("c2_lag_information", f"WITH {SEAS}, {_lag_mi('seas', 48)} SELECT lag, {r('mi')} AS mutual_information FROM mi")
def lag_information(spark, sf):
    curve = information.lag_information(seasonal_series(spark, sf), "y")
    return curve.withColumn("mutual_information", rounded("mutual_information"))


@query("c3_partial_autocorrelation", f"""WITH RECURSIVE {SEAS}, a AS MATERIALIZED {acf_sql("seas", 12)},
  rho AS (SELECT list(acf ORDER BY lag) AS c FROM a),
  d(k, phi, v, p) AS (
    SELECT 1, [c[1]], 1 - c[1] * c[1], c[1] FROM rho
    UNION ALL
    SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - q * phi[k + 1 - j]), q), v * (1 - q * q), q
    FROM (SELECT d.*, (c[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * c[k + 1 - j]))) / v AS q
          FROM d, rho WHERE k < 12))
  SELECT k AS lag, {r("p")} AS pacf FROM d""")
def partial_autocorrelation(spark, sf):
    curve = stattests.pacf(stattests.acf(seasonal_series(spark, sf), "y", 12))
    return curve.select("lag", rounded("pacf").alias("pacf"))


@query("c4_best_lags")
def best_lags(spark, sf):
    series = seasonal_series(spark, sf)
    curve = stattests.pacf(stattests.acf(series, "y", 48))
    return stattests.best_lags(curve, information.lag_information(series, "y"))


@query("c4_acf_and_information_lags", f"""WITH {SEAS}, a AS {acf_sql("seas", 24)}, {_lag_mi('seas', 24)},
  t AS (SELECT lag, row_number() OVER (ORDER BY round(abs(acf), 6) DESC, lag) AS k FROM a
        WHERE abs(acf) > 1.96 / sqrt(n)),
  m AS (SELECT lag, row_number() OVER (ORDER BY round(mi, 6) DESC, lag) AS k FROM mi)
  SELECT 'acf' AS list, CAST(k AS INTEGER) AS rank, lag FROM t WHERE k <= 10
  UNION ALL SELECT 'mi', CAST(k AS INTEGER), lag FROM m WHERE k <= 10""")
def acf_and_information_lags(spark, sf):
    from pyspark.sql import Window

    series = seasonal_series(spark, sf)
    curve = stattests.acf(series, "y", 24).where(F.abs("acf") > 1.96 / F.sqrt("n"))
    lists = curve.select(F.lit("acf").alias("list"), "lag", F.round(F.abs("acf"), 6).alias("s")).unionByName(
        information.lag_information(series, "y", 24).select(
            F.lit("mi").alias("list"), "lag", F.round("mutual_information", 6).alias("s"))
    )
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("s"), "lag"))
    return lists.withColumn("rank", place).where("rank <= 10").select("list", "rank", "lag")


# A wave of 37 rows and a pulse every 11, neither among the usual candidates.
_PLANTED = EV + """, planted AS (SELECT t_idx // 512 AS seg, t_idx % 512 AS p,
    y / 100 + 3 * sin(2 * 3.141592653589793 * t_idx / 37) + CASE WHEN t_idx % 11 = 0 THEN 6 ELSE 0 END + t_idx / 1000.0::DOUBLE AS y FROM ev),
  lines AS (SELECT seg, avg(p) AS mp, avg(y) AS my, coalesce(regr_slope(y, p), 0) AS b, count(*) AS n FROM planted GROUP BY seg),
  residual AS MATERIALIZED (SELECT seg, p, y - my - b * (p - mp) AS e FROM planted JOIN lines USING (seg)),
  spectrum AS MATERIALIZED (SELECT frequency, 512.0::DOUBLE / frequency AS period, sum(c * c + s * s) / (SELECT sum(n) FROM lines) AS power FROM (
    SELECT seg, frequency, sum(e * cos(2 * pi() * frequency * p / 512)) AS c, sum(e * sin(2 * pi() * frequency * p / 512)) AS s
    FROM residual, (SELECT unnest(range(1, 257)) AS frequency) GROUP BY seg, frequency) GROUP BY frequency),
  peaks AS MATERIALIZED (SELECT *, power / sum(power) OVER () AS power_share, power / quantile_cont(power, 0.5) OVER (
      ORDER BY frequency ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS power_ratio,
    power > coalesce(lag(power) OVER o, 0) AND power >= coalesce(lead(power) OVER o, 0) AS peak FROM spectrum WINDOW o AS (ORDER BY frequency)),
  products AS MATERIALIZED (SELECT b.p - a.p AS lag, sum(a.e * b.e) / count(*) AS m, count(*) AS pairs
    FROM residual a JOIN residual b ON a.seg = b.seg AND b.p BETWEEN a.p AND a.p + 256 GROUP BY 1),
  curve AS MATERIALIZED (SELECT lag, m / (SELECT m FROM products WHERE lag = 0) AS acf, pairs FROM products WHERE lag > 0)"""


def _planted(spark, sf):
    at = F.col("t_idx")
    y = F.col("y") / 100 + 3 * F.sin(F.lit(2 * 3.141592653589793) * at / 37) + F.when(at % 11 == 0, 6).otherwise(0) + at / F.lit(1000.0)
    return event_series(spark, sf).select("t_idx", y.alias("y"))


@query("c5_periodogram", f"""WITH {_PLANTED} SELECT frequency, period, {r("power")} AS power, {r("power_share")} AS power_share,
    {r("power_ratio")} AS power_ratio FROM peaks""")
def periodogram(spark, sf):
    found = periods.periodogram(_planted(spark, sf), "y", segment=512)
    return found.withColumns({c: rounded(c) for c in ("power", "power_share", "power_ratio")})


@query("c5_long_acf", f"""WITH {_PLANTED} SELECT lag, {r("acf")} AS acf, pairs FROM curve""")
def long_acf(spark, sf):
    return periods.long_acf(_planted(spark, sf), "y", segment=512).withColumn("acf", rounded("acf"))


@query("c5_found_periods", f"""WITH {_PLANTED},
  lags AS (SELECT frequency, power_ratio, unnest(range(greatest(2, ceil(512 / (frequency + 0.5)))::BIGINT,
      greatest(2, floor(512 / (frequency - 0.5)))::BIGINT + 1)) AS lag FROM peaks WHERE peak AND power_ratio >= 6 AND frequency >= 2),
  best AS (SELECT frequency, power_ratio, lag, acf FROM lags JOIN curve USING (lag)
    QUALIFY row_number() OVER (PARTITION BY frequency ORDER BY round(acf, 6) DESC, lag) = 1),
  beside AS (SELECT b.lag, quantile_cont(c.acf, 0.5) FILTER (c.lag < b.lag) AS before, quantile_cont(c.acf, 0.5) FILTER (c.lag > b.lag) AS after
    FROM (SELECT DISTINCT lag, greatest(1, lag // 8) AS w FROM best) b
    JOIN curve c ON c.lag BETWEEN b.lag - 2 * w AND b.lag - w OR c.lag BETWEEN b.lag + w AND b.lag + 2 * w GROUP BY b.lag),
  tops AS (SELECT lag AS period, max(acf) AS acf, max(power_ratio) AS power_ratio FROM best JOIN beside USING (lag)
    WHERE acf > 0.1 AND acf > coalesce(before, -1) AND acf > coalesce(after, -1) GROUP BY lag)
  SELECT period, {r("acf")} AS acf, {r("power_ratio")} AS power_ratio,
    CAST(row_number() OVER (ORDER BY round(acf, 6) DESC, period) AS INTEGER) AS rank FROM tops""")
def found_periods(spark, sf):
    found = periods.find_periods(_planted(spark, sf), "y", segment=512)
    return found.withColumns({c: rounded(c) for c in ("acf", "power_ratio")})


@query("c5_seasonality", f"""WITH {SEAS}, s AS (
    SELECT * FROM {phase_sql("seas", 7)} UNION ALL SELECT * FROM {phase_sql("seas", 12)}
    UNION ALL SELECT * FROM {phase_sql("seas", 24)}),
  w AS ({" UNION ALL ".join(f'''SELECT {p} AS period, 2 * (pow(covar_pop(y, cos(2 * pi() * t_idx / {p})), 2)
      + pow(covar_pop(y, sin(2 * pi() * t_idx / {p})), 2)) / var_pop(y) AS share FROM seas''' for p in (7, 12, 24))})
  SELECT period, {r("seasonal_strength")} AS seasonal_strength, {r("trend_strength")} AS trend_strength,
    {r("share")} AS spectral_share,
    CASE WHEN seasonal_strength > 0.5 THEN 'strong seasonality' WHEN seasonal_strength >= 0.2
      THEN 'weak seasonality' ELSE 'no clear seasonality' END AS label,
    period = (SELECT period FROM s ORDER BY round(seasonal_strength, 6) DESC, period LIMIT 1) AS dominant
  FROM s JOIN w USING (period)""")
def seasonality_strength(spark, sf):
    found = seasonality.detect_seasonality(seasonal_series(spark, sf), "y", [7, 12, 24])
    return found.withColumns(
        {c: rounded(c) for c in ("seasonal_strength", "trend_strength", "spectral_share")}
    )


@query("c6_fourier_features", f"""WITH {EV} SELECT event_id, {", ".join(
    r(f"{f}(2 * pi() * {k} * t_idx / 24.0::DOUBLE)") + f" AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos"))} FROM ev""")
def fourier(spark, sf):
    waves = fx.fourier_features(24)
    built = fx.build(event_series(spark, sf), waves)
    return built.select("event_id", *[rounded(f.name).alias(f.name) for f in waves])


def _distribution_sql(src: str) -> str:
    return f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {src}),
  m AS (SELECT avg(value) AS mu, var_pop(value) AS v FROM {src}),
  s AS (SELECT min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
    avg(pow(value - mu, 3)) / pow(any_value(v), 1.5) AS skewness, kurtosis_pop(value) AS kurtosis,
    any_value(q3 - q1) AS iqr,
    avg(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS outlier_fraction
    FROM {src}, q, m),
  c AS (SELECT *, std / abs(mean) AS cv FROM s)
  SELECT {", ".join(r(c) + f" AS {c}" for c in ("min", "max", "mean", "std", "skewness", "kurtosis", "iqr",
                                                "outlier_fraction", "cv"))},
    CASE WHEN cv > 3 THEN 'not suitable'
      WHEN (outlier_fraction < 0.05)::INT + (cv < 1)::INT + (abs(skewness) < 1)::INT = 3 THEN 'yes'
      WHEN (outlier_fraction < 0.05)::INT + (cv < 1)::INT + (abs(skewness) < 1)::INT >= 1 THEN 'conditional'
      ELSE 'not suitable' END AS tree_model_suitable FROM c"""


@query("c7_target_distribution", _distribution_sql("events"))
def target_distribution(spark, sf):
    stats = fx.target_distribution(table(spark, sf, "events"), "value")
    return stats.withColumns({c: rounded(c) for c in stats.columns if c != "tree_model_suitable"})


@query("c7_target_with_nan", _distribution_sql("(SELECT value FROM events WHERE event_id % 13 != 0 AND event_id % 17 != 0)"))
def target_with_nan(spark, sf):
    value = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).when(F.col("event_id") % 17 != 0, F.col("value"))
    stats = fx.target_distribution(table(spark, sf, "events").select(value.alias("value")), "value")
    return stats.withColumns({c: rounded(c) for c in stats.columns if c != "tree_model_suitable"})


@query("c8_automatic_delay", f"""WITH {SEAS}, {_lag_mi('seas', 20)}, n AS (
    SELECT lag, v, lag(v) OVER (ORDER BY lag) AS b, lead(v) OVER (ORDER BY lag) AS a
    FROM (SELECT lag, round(mi, 9) AS v FROM mi))
  SELECT coalesce(min(CASE WHEN v < b AND v < a THEN lag END), arg_min(lag, (v, lag))) AS delay FROM n""")
def automatic_delay(spark, sf):
    return information.first_local_minimum(information.lag_information(seasonal_series(spark, sf), "y", 20))


@query("c9_delay_embedding", f"""WITH {EV} SELECT event_id, {_lag(1)} AS y_emb_0, {_lag(6)} AS y_emb_1,
  {_lag(11)} AS y_emb_2 FROM ev""")
def embedding(spark, sf):
    plan = fx.embedding_features("y", 5)
    return fx.build(event_series(spark, sf), plan).select("event_id", *[f.name for f in plan])


@query("c10_strata", f"""WITH {EV} SELECT event_id, CAST(hour(t) AS INTEGER) AS hour_of_day,
  CAST(isodow(t) - 1 AS INTEGER) AS day_of_week FROM ev""")
def strata(spark, sf):
    series = event_series(spark, sf)
    step = profile.step_seconds(series).first()["step_seconds"]
    built = fx.strata_features(series, step)
    return built.select("event_id", *[c for c in built.columns if c not in series.columns])


@query("c10_long_strata", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST((month(o_orderdate) % 12) // 3 AS INTEGER) AS season FROM orders""")
def long_strata(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    return fx.strata_features(orders, 86400).drop("t")


@query("c11_strata_usefulness", f"""WITH l AS (
    SELECT 'hour' AS stratum, hour(ts)::VARCHAR AS level, value AS y FROM events
    UNION ALL SELECT 'event_type', event_type, value FROM events
    UNION ALL SELECT 'band', CASE WHEN value > 50 THEN 'high' ELSE 'low' END, value FROM events),
  g AS (SELECT stratum, level, y, avg(y) OVER (PARTITION BY stratum, level) AS m, avg(y) OVER (PARTITION BY stratum) AS a FROM l),
  s AS (SELECT stratum, count(DISTINCT level) AS groups, count(*) AS n, sum(pow(y - m, 2)) AS w, sum(pow(m - a, 2)) AS b FROM g GROUP BY stratum)
  SELECT stratum, groups, {r("(b / (groups - 1)) / (w / (n - groups))")} AS f_stat, {r("b / (b + w)")} AS variance_ratio FROM s""")
def strata_usefulness(spark, sf):
    events = table(spark, sf, "events").select(
        F.hour("ts").alias("hour"), "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("band"),
        F.col("value").alias("y"),
    )
    tested = stattests.anova(events, "y", ["hour", "event_type", "band"])
    return tested.select("stratum", "groups", rounded("f_stat").alias("f_stat"),
                         rounded("variance_ratio").alias("variance_ratio"))


@query("c11_strata_p_values")
def strata_p_values(spark, sf):
    events = table(spark, sf, "events").select(F.hour("ts").alias("hour"), "event_type", F.col("value").alias("y"))
    return stattests.anova(events, "y", ["hour", "event_type"])


@query("c12_lag_features", f"""WITH {EV} SELECT event_id, {_lag(1)} AS y_lag_1, {_lag(2)} AS y_lag_2,
  {_lag(24)} AS y_lag_24, {_lag(1, "x")} AS x_lag_1, {_lag(3, "x")} AS x_lag_3 FROM ev""")
def lag_features(spark, sf):
    plan = [*fx.lag_features("y", [1, 2, 24]), *fx.lag_features("x", [1, 3], "x", "source")]
    return fx.build(event_series(spark, sf), plan).select("event_id", *[f.name for f in plan])


@query("c12_lag_features_panel", f"""WITH {PANEL} SELECT event_id, lag(y, 1) OVER w AS y_lag_1, lag(y, 7) OVER w AS y_lag_7
  FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY t_idx)""")
def lag_features_panel(spark, sf):
    plan = fx.lag_features("y", [1, 7])
    return fx.build(event_panel(spark, sf), plan, ["event_type"]).select("event_id", "y_lag_1", "y_lag_7")


def _roll(fn: str, n: int) -> str:
    w = f"OVER (ORDER BY t_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) {w} = {n} THEN {fn}(y) {w} END"


def _roll_range(n: int) -> str:
    return f"({_roll('max', n)}) - ({_roll('min', n)})"


@query("c13_rolling_features", f"""WITH {EV} SELECT event_id, {", ".join(
    f"{r(_roll('avg', n))} AS y_rolling_mean_{n}, {r(_roll('stddev_samp', n))} AS y_rolling_std_{n}, "
    f"{_roll('min', n)} AS y_rolling_min_{n}, {_roll('max', n)} AS y_rolling_max_{n}, "
    f"{r(_roll_range(n))} AS y_rolling_range_{n}"
    for n in (7, 14, 30))} FROM ev""")
def rolling_features(spark, sf):
    plan = fx.rolling_features("y")
    built = fx.build(event_series(spark, sf), plan)
    exact = ("min", "max")
    return built.select("event_id", *[
        F.col(f.name) if any(f"_{e}_" in f.name for e in exact) else rounded(f.name).alias(f.name) for f in plan
    ])


@query("c14_differencing", f"""WITH {EV} SELECT event_id, {r(f"{_lag(1)} - {_lag(2)}")} AS y_diff_1,
  {r(f"{_lag(1)} - {_lag(8)}")} AS y_diff_7, {r(f"{_lag(1)} - {_lag(366)}")} AS y_diff_365,
  {r(f"{_lag(1)} - 2 * {_lag(2)} + {_lag(3)}")} AS y_diff_2,
  {r(f"({_lag(1)} - {_lag(2)}) / nullif({_lag(2)}, 0)")} AS y_pct_change_1 FROM ev""")
def differencing(spark, sf):
    plan = fx.differencing_features("y", (1, 7, 365))
    built = fx.build(event_series(spark, sf), plan)
    return built.select("event_id", *[rounded(f.name).alias(f.name) for f in plan])


@query("c15_trend_features", f"""WITH {EV} SELECT event_id, t_idx::DOUBLE AS t_index, t_idx::DOUBLE * t_idx AS t_index_squared,
  (epoch_us(t) - (SELECT min(epoch_us(t)) FROM ev))::DOUBLE / 86400000000.0::DOUBLE AS t_elapsed_days FROM ev""")
def trend_features(spark, sf):
    built = fx.trend_features(event_series(spark, sf))
    return built.select("event_id", "t_index", "t_index_squared", "t_elapsed_days")


@query("c16_calendar_features", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
  CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""")
def calendar_features(spark, sf):
    plan = fx.calendar_features("ts")
    return fx.build(table(spark, sf, "events"), plan).select("event_id", *[f.name for f in plan])


@query("c17_seasonal_lags", f"""WITH {SEAS}, a AS {acf_sql("seas", 24)}, s AS (
    SELECT lag FROM a WHERE acf > 0.1 AND lag % 7 = 0)
  SELECT event_id, {", ".join(f"CASE WHEN {k} IN (SELECT lag FROM s) THEN {r(_lag(k))} END AS y_lag_{k}" for k in (7, 14, 21))} FROM seas""")
def seasonal_lags(spark, sf):
    series = seasonal_series(spark, sf)
    found = [x["lag"] for x in stattests.significant_lags(stattests.acf(series, "y", 24)).collect()]
    plan = fx.lag_features("y", fx.seasonal_lags(found, 7))
    built = fx.build(series, plan)
    return built.select("event_id", *[rounded(f.name).alias(f.name) for f in plan])


@query("c18_adaptive_features", f"""WITH {SEAS} SELECT event_id, {", ".join(
    r(_lag(k)) + f" AS y_lag_{k}" for k in (1, 2, 7, 14))}, {r(f"{_lag(1)} - {_lag(2)}")} AS y_diff_1,
  {r(f"{_lag(1)} - {_lag(8)}")} AS y_diff_7, {r(f"{_lag(1)} - 2 * {_lag(2)} + {_lag(3)}")} AS y_diff_2,
  {r(f"({_lag(1)} - {_lag(2)}) / nullif({_lag(2)}, 0)", 3)} AS y_pct_change_1,
  {", ".join(r(f"{f}(2 * pi() * {k} * t_idx / 7.0::DOUBLE)") + f" AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos"))} FROM seas""")
def adaptive(spark, sf):
    profile_row = {"trend_detected": True, "seasonality_detected": True, "stationary": True}
    plan = fx.adaptive_features("y", profile_row, [1, 2, 7, 14], 7)
    built = fx.build(seasonal_series(spark, sf), plan)
    return built.select("event_id", *[
        rounded(f.name, 3 if "pct" in f.name else 6).alias(f.name) for f in plan
    ])


@query("c19_model_features", f"""WITH {EV} SELECT event_id, {r(f"{_lag(1)} - {_lag(2)}")} AS y_diff_1,
  {r(f"{_lag(1)} - 2 * {_lag(2)} + {_lag(3)}")} AS y_diff_2,
  {r(f"({_lag(1)} - {_lag(2)}) / nullif({_lag(2)}, 0)")} AS y_pct_change_1,
  {r(_lag(1))} AS y_emb_0, {r(_lag(3))} AS y_emb_1, {r(_lag(5))} AS y_emb_2,
  {", ".join(r(f"{_lag(a)} * {_lag(b)}") + f" AS y_lag_{a}_x_lag_{b}" for a, b in ((1, 2), (1, 7), (2, 7)))},
  {", ".join(r(f"{f}(2 * pi() * {k} * t_idx / 7.0::DOUBLE)") + f" AS {f}_{k}" for k in (1, 2) for f in ("sin", "cos"))} FROM ev""")
def model_features(spark, sf):
    models = ["SARIMA", "LSTM", "Gradient Boosting", "State-Space"]
    plan = fx.features_for_models("y", models, ["y_lag_1"], [1, 2, 7], delay=2, period=7)
    built = fx.build(event_series(spark, sf), plan)
    return built.select("event_id", *[rounded(f.name).alias(f.name) for f in plan])


@query("c20_panel_features", f"""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS t, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y
    FROM events GROUP BY ALL),
  o AS (SELECT *, (sum(y) OVER (PARTITION BY t) - y) / nullif(count(*) OVER (PARTITION BY t) - 1, 0) AS m FROM h),
  ids AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS i FROM (SELECT event_type, count(*) AS n FROM h GROUP BY 1))
  SELECT event_type, t, y, i::DOUBLE AS series_id, {r("lag(m) OVER (PARTITION BY event_type ORDER BY t)", 4)} AS others_mean_lag_1
  FROM o JOIN ids USING (event_type)""")
def panel_features(spark, sf):
    from tidecast.operators.order import dense_index

    hours = table(spark, sf, "events").groupBy(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")
    ).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("y"))
    panel = dense_index(hours, ["t"], ["event_type"])
    built = fx.cross_series_mean(panel, ["event_type"])
    return fx.series_codes(built, ["event_type"]).select("event_type", "t", "y", "series_id", rounded("others_mean_lag_1", 4).alias("others_mean_lag_1"))


@query("c21_warm_up", """SELECT least(30, count(*)) AS rows_dropped_by_lags, greatest(count(*) - 30, 0) AS final_row_count FROM events""")
def warm_up(spark, sf):
    return fx.drop_warm_up(event_series(spark, sf), 30)[1]


def full_plan(col: str) -> list[fx.Feature]:
    """The feature set of a default run."""
    return [
        *fx.lag_features(col, [1, 2, 3, 7]), *fx.rolling_features(col), *fx.differencing_features(col),
        *fx.fourier_features(7), *fx.calendar_features(),
    ]


@query("c23_model_preselection", """SELECT * FROM (VALUES
  ('Linear Models', 1.0::DOUBLE, 'suitable', 1, true), ('SARIMA', 1.0, 'suitable', 2, true),
  ('Tree-Based', 1.0, 'suitable', 3, true), ('Gradient Boosting', 0.75, 'suitable', 4, false),
  ('State-Space', 0.6, 'somewhat suitable', 5, false), ('LSTM', 0.0, 'not suitable', 6, false))
  v(model_type, score, suitability, rank, top_3)""")
def model_preselection(spark, sf):
    built = fx.build(seasonal_series(spark, sf), full_plan("y"))
    names = spark.createDataFrame([(c,) for c in built.columns if c not in ("event_id", "t", "t_idx", "x", "y")], "feature string")
    chosen = fx.preselect_models(names, {"rows": built.count(), "seasonality_detected": True})
    return chosen.select("model_type", "score", "suitability", "rank", "top_3")


@query("c25_scaling_metadata", """WITH b AS (SELECT 'y_lag_1' AS feature, false AS never_scale UNION ALL SELECT 'hour', false
    UNION ALL SELECT 'is_weekend', (SELECT count_if(NOT ((isodow(ts) >= 6)::INT IN (0, 1))) = 0 FROM events))
  SELECT m AS model_type, feature, CASE WHEN never_scale THEN NULL ELSE s END AS scaler, never_scale
  FROM b, (VALUES ('SARIMA', 'StandardScaler'), ('LSTM', 'MinMaxScaler'), ('Gradient Boosting', NULL)) v(m, s)""")
def scaling_metadata(spark, sf):
    plan = [*fx.lag_features("y", [1]), *fx.calendar_features()]
    built = fx.build(event_series(spark, sf), plan).select("y", "y_lag_1", "hour", "is_weekend")
    return fx.scaling_metadata(built, "y", ["SARIMA", "LSTM", "Gradient Boosting"])


@query("c26_scaling", f"""WITH {EV}, f AS (SELECT event_id, t_idx, {_lag(1)} AS a, {_lag(2, "x")} AS b FROM ev),
  k AS (SELECT * FROM f WHERE t_idx >= 2), n AS (SELECT floor(0.8 * count(*)) AS first FROM ev),
  s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, min(b) AS lb, max(b) AS hb FROM k, n WHERE t_idx < first)
  SELECT event_id, {r("(a - ma) / sa")} AS y_lag_1_scaled, {r("(b - lb) / (hb - lb)")} AS x_lag_2_scaled FROM k, s""")
def scaling_fit_on_train(spark, sf):
    plan = [*fx.lag_features("y", [1]), *fx.lag_features("x", [2], "x", "source")]
    series = event_series(spark, sf)
    built = fx.build(series, plan)
    train, holdout = split.chronological(built)
    steps = Pipeline(stages=[
        *scaling.scaler_stages("StandardScaler", ["y_lag_1"]), *scaling.scaler_stages("MinMaxScaler", ["x_lag_2"]),
    ])
    model = steps.fit(train.where("t_idx >= 2"))
    scaled = scaling.spread(model.transform(built.where("t_idx >= 2")), {"StandardScaler": ["y_lag_1"], "MinMaxScaler": ["x_lag_2"]})
    return scaled.select("event_id", rounded("y_lag_1_scaled").alias("y_lag_1_scaled"), rounded("x_lag_2_scaled").alias("x_lag_2_scaled"))


@query("c27_leakage_by_correlation", f"""WITH {EV}, f AS (SELECT y, {_lag(1)} AS y_lag_1, y * 2 + 1 AS scaled_copy,
    y + x / 1000 AS near_copy, x FROM ev)
  SELECT feature, {r("c")} AS correlation, abs(c) >= 0.98 AND feature <> 'y_lag_1' AS candidate FROM ({
    " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS c FROM f" for c in ("y_lag_1", "scaled_copy", "near_copy", "x"))})""")
def leakage_by_correlation(spark, sf):
    built = fx.build(event_series(spark, sf), fx.lag_features("y", [1])).withColumns({
        "scaled_copy": F.col("y") * 2 + 1, "near_copy": F.col("y") + F.col("x") / 1000,
    })
    found = leakage.detect_leakage(built, ["y_lag_1", "scaled_copy", "near_copy", "x"], "y")
    return found.withColumn("correlation", rounded("correlation"))


@query("c28_reconstruction_probe")
def reconstruction_probe(spark, sf):
    """A copied target is rebuilt, an honest lag is not."""
    built = fx.build(seasonal_series(spark, sf), fx.lag_features("y", [1])).withColumn("copy", F.col("y") * 2)
    rows = [
        (c, leakage.reconstruction_probe(built, [c], "y")) for c in ("copy", "y_lag_1")
    ]
    return spark.createDataFrame(rows, "feature string, probe_r2 double").withColumn(
        "confirmed", F.col("probe_r2") > leakage.CONFIRMED_R2
    )


@query("c28_confirmed_leaks", f"""WITH {SEAS}, f AS (SELECT y, y * 2 AS copy, lag(y, 1) OVER (ORDER BY t_idx) AS y_lag_1 FROM seas)
  SELECT 'copy' AS feature, corr(copy, y) ** 2 > 0.9 AS rebuilt FROM f
  UNION ALL SELECT 'y_lag_1', corr(y_lag_1, y) ** 2 > 0.9 FROM f""")
def confirmed_leaks(spark, sf):
    """Which columns rebuild the target: nearly all of its variance, by either measure."""
    built = fx.build(seasonal_series(spark, sf), fx.lag_features("y", [1])).withColumn("copy", F.col("y") * 2)
    rows = [(c, leakage.reconstruction_probe(built, [c], "y") > 0.9) for c in ("copy", "y_lag_1")]
    return spark.createDataFrame(rows, "feature string, rebuilt boolean")


_AUDITED = [f.name for f in full_plan("y")]


@query("c29_causality_audit", f"""SELECT unnest({_AUDITED}) AS feature, (count(*) - 1) // 62 + 1 AS probes, 0::BIGINT AS changed FROM events""")
def causality_audit(spark, sf):
    audit = leakage.causality_audit(seasonal_series(spark, sf), full_plan)
    return audit.select("feature", "probes", "changed")


@query("c30_leakage_audit", f"""SELECT unnest({_AUDITED}) AS feature, 'pass' AS status, '' AS reason FROM (SELECT count(*) FROM events)""")
def leakage_audit(spark, sf):
    """Audit of the default features; the written features exist only on a pass."""
    from tidecast.storage import scratch_path

    built, audit = leakage.leakage_audit(seasonal_series(spark, sf), full_plan)
    leakage.write_audited(built, audit, scratch_path(spark, "features"), scratch_path(spark, "audit"))
    return audit.select("feature", "status", "reason")


@query("c30_leakage_audit_fails", f"""WITH {EV} SELECT 'now' AS feature, 'fail' AS status, true AS stopped FROM (SELECT count(*) FROM ev)
  UNION ALL SELECT 'y_lag_1', 'pass', true""")
def leakage_audit_fails(spark, sf):
    """A rolling mean that includes the current row stops the run."""
    from tidecast.storage import scratch_path

    def leaky(col):
        now = fx.Feature("now", lambda w: F.avg(col).over(w.rowsBetween(-2, 0)), 1, 2, ("target", "rolling"))
        return [now, *fx.lag_features(col, [1])]

    built, audit = leakage.leakage_audit(event_series(spark, sf), leaky)
    stopped = False
    try:
        leakage.write_audited(built, audit, scratch_path(spark, "features"), scratch_path(spark, "audit"))
    except RuntimeError:
        stopped = True
    return audit.select("feature", "status", F.lit(stopped).alias("stopped"))
