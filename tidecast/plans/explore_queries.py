"""Exploration: profiles, filters, information, series tests."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tidecast.operators import information, profile, screening, seasonality, stattests
from tidecast.plans.inputs import (
    DAYS, EV, PANEL, SEAS, daily_revenue, event_panel, event_series, r, rounded, seasonal_series, table,
)
from tidecast.plans.registry import query

_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _each(template: str, names) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


@query("b1_univariate_stats", _each(f"""
  SELECT '{{c}}' AS "column", {r("avg({c})")} AS mean, {r("stddev_samp({c})")} AS std,
         min({{c}})::DOUBLE AS min, max({{c}})::DOUBLE AS max, 0.0::DOUBLE AS missing_fraction FROM lineitem""",
                                    _NUMBERS))
def univariate(spark, sf):
    stats = profile.univariate_stats(table(spark, sf, "lineitem"), _NUMBERS)
    return stats.withColumns({c: rounded(c) for c in ("mean", "std")})


@query("b2_column_classes", """
  SELECT column_name AS "column",
         CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric'
              WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'time' END AS column_class
  FROM (SELECT unnest(['l_orderkey','l_partkey','l_suppkey','l_linenumber','l_quantity','l_extendedprice',
    'l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate']) AS column_name,
    unnest([typeof(l_orderkey), typeof(l_partkey), typeof(l_suppkey), typeof(l_linenumber), typeof(l_quantity),
    typeof(l_extendedprice), typeof(l_discount), typeof(l_tax), typeof(l_returnflag), typeof(l_linestatus),
    typeof(l_shipdate)]) AS data_type FROM (SELECT * FROM lineitem LIMIT 1))""")
def column_classes(spark, sf):
    return profile.column_classes(table(spark, sf, "lineitem"))


@query("b3_low_variance", f"""
  SELECT "column", {r("sv", 9)} AS scaled_variance, sv < 1e-4 AS low_variance FROM ({_each('''
    SELECT '{c}' AS "column", coalesce(CASE WHEN max({c}) > min({c}) THEN
      var_samp({c}) / pow(max({c}) - min({c}), 2) END, 0.0) AS sv FROM w''', ['l_quantity', 'flat', 'spike'])})
  """.replace("FROM w", """FROM (SELECT l_quantity, 5.0 AS flat,
      CASE WHEN l_orderkey % 20000 = 7 AND l_linenumber = 1 THEN 1.0 ELSE 0.0 END AS spike FROM lineitem)"""))
def low_variance(spark, sf):
    spike = F.expr("if(l_orderkey % 20000 = 7 and l_linenumber = 1, 1D, 0D)")
    line = table(spark, sf, "lineitem").select("l_quantity", F.lit(5.0).alias("flat"), spike.alias("spike"))
    flags = profile.low_variance(line, ["l_quantity", "flat", "spike"])
    return flags.withColumn("scaled_variance", rounded("scaled_variance", 9))


@query("b4_high_cardinality", _each("""
  SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) > 50 AS high_cardinality
  FROM customer""", ["c_name", "c_mktsegment"]))
def high_cardinality(spark, sf):
    return profile.high_cardinality(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], exact=True)


_LINE = """line AS (SELECT l_extendedprice AS y, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
    l_extendedprice * (1 - l_discount) AS net, l_extendedprice + l_tax AS copy,
    l_quantity * 2 + l_tax AS twin,
    l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS k FROM lineitem)"""
_LINE_FEATURES = ["quantity", "discount", "tax", "net", "copy", "twin"]


def line_features(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") + F.col("l_tax")).alias("copy"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twin"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("k"),
    )


@query("b5_leakage_suspects", f"""WITH {_LINE} SELECT feature, {r("c")} AS correlation, abs(c) > 0.98 AS leakage_suspect
  FROM ({_each("SELECT '{c}' AS feature, corr({c}, y) AS c FROM line", _LINE_FEATURES)})""")
def leakage_suspects(spark, sf):
    found = profile.target_correlations(line_features(spark, sf), _LINE_FEATURES, "y")
    return found.withColumn("correlation", rounded("correlation"))


@query("b5_leakage_of_late_columns", f"""WITH late AS (SELECT l_extendedprice AS y,
    CASE WHEN l_orderkey > 600 THEN l_extendedprice + l_tax END AS late_copy, CASE WHEN l_orderkey < 0 THEN 1.0 END AS empty,
    l_quantity * 0 AS flat FROM lineitem)
  SELECT feature, {r("c")} AS correlation, coalesce(abs(c) > 0.98, feature = 'empty') AS leakage_suspect FROM (
    SELECT 'late_copy' AS feature, corr(late_copy, y) AS c FROM late
    UNION ALL SELECT 'empty', NULL FROM (SELECT count(*) FROM late) UNION ALL SELECT 'flat', NULL FROM (SELECT count(*) FROM late))""")
def late_leakage(spark, sf):
    """A copy of the target that is null in its first rows, a column without values, and a constant one."""
    late = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"),
        F.when(F.col("l_orderkey") > 600, F.col("l_extendedprice") + F.col("l_tax")).alias("late_copy"),
        F.when(F.col("l_orderkey") < 0, F.lit(1.0)).alias("empty"), (F.col("l_quantity") * 0).alias("flat"),
    )
    found = profile.target_correlations(late, ["late_copy", "empty", "flat"], "y")
    return found.withColumn("correlation", rounded("correlation"))


def _edges(col: str, src: str) -> str:
    return f"(SELECT quantile_cont({col}, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]) FROM {src})"


def _binned(col: str, src: str) -> str:
    return f"len(list_filter(list_distinct({_edges(col, src)}), lambda e: {col} > e))"


def _mi(pairs: str, keys: str) -> str:
    """Mutual information per key from a query yielding keys, xbin, ybin."""
    return f"""(SELECT {keys}, sum(p * ln(p / (px * py))) AS mi FROM (
      SELECT {keys}, n / sum(n) OVER (PARTITION BY {keys}) AS p,
        sum(n) OVER (PARTITION BY {keys}, xbin) / sum(n) OVER (PARTITION BY {keys}) AS px,
        sum(n) OVER (PARTITION BY {keys}, ybin) / sum(n) OVER (PARTITION BY {keys}) AS py
      FROM (SELECT {keys}, xbin, ybin, count(*) AS n FROM ({pairs}) GROUP BY ALL)) GROUP BY {keys})"""


_NOISE = [f"noise_{i}" for i in range(5)]


def _word(seed: int, i: int) -> str:
    return f"((('0x' || substr(md5(k || '|noise{seed}'), {8 * i + 1}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def _normal(i: int) -> str:
    block, place = divmod(i, 4)
    pair, part = divmod(place, 2)
    turn = "cos" if part == 0 else "sin"
    return (f"sqrt(-2.0 * ln({_word(block, 2 * pair)})) * "
            f"{turn}(2 * 3.141592653589793 * {_word(block, 2 * pair + 1)}) AS noise_{i}")


_NOISY = f"{_LINE}, noisy AS (SELECT *, {', '.join(_normal(i) for i in range(5))} FROM line)"
# Octiles of the standard normal distribution.
_OCTILES = [NormalDist().inv_cdf(i / 8) for i in range(1, 8)]


def _noise_bin(col: str) -> str:
    return f"len(list_filter({[f'{e!r}' for e in _OCTILES]}::DOUBLE[], lambda e: {col} > e))"


_RANKED = f"""{_NOISY}, mi AS {_mi(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_noise_bin(c) if c in _NOISE else _binned(c, 'noisy')} AS xbin, "
    f"{_binned('y', 'noisy')} AS ybin FROM noisy"
    for c in [*_LINE_FEATURES, *_NOISE]), "feature")}"""


@query("b6_mutual_information", f"""WITH {_RANKED}, base AS (SELECT avg(mi) AS b FROM mi WHERE feature LIKE 'noise%')
  SELECT feature, {r("mi")} AS mi_score, mi <= b AS below_noise_baseline FROM mi, base WHERE feature NOT LIKE 'noise%'""")
def mutual_information(spark, sf):
    ranking, _ = information.information_ranking(line_features(spark, sf), _LINE_FEATURES, "y", F.col("k"))
    return ranking.withColumn("mi_score", rounded("mi_score"))


_FOLD_FEATURES = ["discount", "tax", "line", "supplier", "folded"]
_FOLDED = """folded_rows AS (SELECT l_extendedprice AS y, l_discount AS discount, l_tax AS tax, l_linenumber::DOUBLE AS line,
    l_suppkey::DOUBLE AS supplier, pow(l_extendedprice - 40000, 2) AS folded FROM lineitem)"""


@query("b5_anomalous_information", f"""WITH {_FOLDED}, scores AS {_mi(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_binned(c, 'folded_rows')} AS xbin, {_binned('y', 'folded_rows')} AS ybin FROM folded_rows" for c in _FOLD_FEATURES),
    "feature")},
  fence AS (SELECT quantile_cont(mi, 0.75) + 3 * greatest(quantile_cont(mi, 0.75) - quantile_cont(mi, 0.25), 0.05 * ln(8)) AS fence FROM scores)
  SELECT feature, {r("mi")} AS mi, {r("fence")} AS fence, mi > fence AS leakage_suspect FROM scores, fence""")
def anomalous_information(spark, sf):
    """A folded copy of the target: much information, little correlation."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"), F.col("l_suppkey").cast("double").alias("supplier"),
        F.pow(F.col("l_extendedprice") - 40000, F.lit(2.0)).alias("folded"))
    found = information.anomalous_information(rows, _FOLD_FEATURES, "y")
    return found.withColumns({c: rounded(c) for c in ("mi", "fence")})


@query("b7_noise_baseline", f"""WITH {_RANKED} SELECT {r("avg(mi)")} AS noise_mi_baseline
  FROM mi WHERE feature LIKE 'noise%'""")
def noise_baseline(spark, sf):
    noisy, names = information.with_noise(line_features(spark, sf).select("y", "k"), F.col("k"))
    scored = information.mutual_information(noisy, names, "y", known_edges=information.noise_edges(names))
    return scored.agg(rounded(F.avg("mi")).alias("noise_mi_baseline"))


@query("b8_noise_filter", f"""WITH {_RANKED}, base AS (SELECT avg(mi) AS b FROM mi WHERE feature LIKE 'noise%'),
  pool AS (SELECT feature, mi FROM mi WHERE feature IN ('discount', 'tax', 'quantity', 'twin')),
  t AS (SELECT CASE WHEN (SELECT max(mi) FROM pool) > b THEN b ELSE b * 0.5 END AS threshold,
        (SELECT max(mi) FROM pool) <= b AS loosened FROM base)
  SELECT feature, {r("threshold")} AS threshold, loosened FROM pool, t
  WHERE mi > threshold OR (NOT EXISTS (SELECT 1 FROM pool WHERE mi > threshold)
    AND feature = (SELECT max_by(feature, mi) FROM pool))""")
def noise_filter(spark, sf):
    pool = ["discount", "tax", "quantity", "twin"]
    ranking, baseline = information.information_ranking(line_features(spark, sf), pool, "y", F.col("k"))
    kept, threshold, loosened = screening.above_noise(
        [(x["feature"], x["mi_score"]) for x in ranking.collect()], baseline
    )
    rows = [(f, round(threshold, 6), loosened) for f in kept]
    return spark.createDataFrame(rows, "feature string, threshold double, loosened boolean")


@query("b8_relaxed_screening", f"""WITH {_RANKED}, base AS (SELECT avg(mi) AS b FROM mi WHERE feature LIKE 'noise%'),
  pool AS (SELECT feature, mi FROM mi WHERE feature IN ('discount', 'tax', 'quantity', 'twin')),
  weaker AS (SELECT feature FROM pool WHERE feature IN ('quantity', 'twin') ORDER BY round(mi, 6), feature LIMIT 1),
  passes AS (SELECT * FROM (VALUES ('first', 1.0::DOUBLE), ('relaxed', 0.5::DOUBLE)) t(pass, share))
  SELECT pass, feature, {r("mi")} AS mi FROM pool, base, passes WHERE mi > b * share AND feature NOT IN (SELECT feature FROM weaker)""")
def relaxed_screening(spark, sf):
    """What the noise baseline lets through, and half of it in the second pass."""
    line = line_features(spark, sf)
    first = screening.screen_features(line, "y", F.col("k"), ["discount", "tax", "quantity", "twin"])
    rows = [(name, f, round(first.mi[f], 6) + 0.0) for name, found in (("first", first), ("relaxed", screening.relaxed_screening(line, first)))
            for f in found.recommended]
    return spark.createDataFrame(rows, "pass string, feature string, mi double")


_PAIR_SQL = f"""WITH {_LINE}, pairs AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM line"
    for i, a in enumerate(_LINE_FEATURES) for b in _LINE_FEATURES[i + 1:])})"""


@query("b9_correlation_matrix", f"{_PAIR_SQL} SELECT column_a, column_b, {r('correlation')} AS correlation FROM pairs")
def correlation_matrix(spark, sf):
    pairs = profile.correlation_pairs(line_features(spark, sf), _LINE_FEATURES)
    return pairs.withColumn("correlation", rounded("correlation"))


# Twenty columns, each null in a seventh of the rows of its own.
_WIDE = {f"c{k}": f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN l_quantity * {k % 3} + l_discount * {k} * 10 + l_tax * {k % 5} END"
         for k in range(1, 21)}
_WIDE_SQL = f"WITH wide AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _WIDE.items())} FROM lineitem)"


@query("b9_wide_matrix_with_gaps", f"""{_WIDE_SQL} SELECT column_a, column_b, {r('correlation')} AS correlation FROM ({
    " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM wide"
                       for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1:])})""")
def wide_matrix(spark, sf):
    wide = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()])
    return profile.correlation_pairs(wide, list(_WIDE)).withColumn("correlation", rounded("correlation"))


@query("b9_strongest_pair", f"""{_PAIR_SQL} SELECT column_a, column_b, {r('correlation')} AS correlation FROM pairs
  ORDER BY round(abs(correlation), 6) DESC, column_a DESC, column_b DESC LIMIT 1""")
def strongest_pair(spark, sf):
    pairs = profile.correlation_pairs(line_features(spark, sf), _LINE_FEATURES)
    return profile.strongest_pair(pairs).withColumn("correlation", rounded("correlation"))


@query("b10_redundant_features", f"""WITH {_RANKED}, pairs AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS c FROM line"
    for i, a in enumerate(_LINE_FEATURES) for b in _LINE_FEATURES[i + 1:])})
  SELECT DISTINCT CASE WHEN (round(a.mi, 6), a.feature) < (round(b.mi, 6), b.feature)
      THEN a.feature ELSE b.feature END AS feature
  FROM pairs JOIN mi a ON a.feature = column_a JOIN mi b ON b.feature = column_b WHERE abs(c) >= 0.90""")
def redundant_features(spark, sf):
    line = line_features(spark, sf)
    ranking, _ = information.information_ranking(line, _LINE_FEATURES, "y", F.col("k"))
    mi = {x["feature"]: x["mi_score"] for x in ranking.collect()}
    pairs = [tuple(p) for p in profile.correlation_pairs(line, _LINE_FEATURES).collect()]
    return spark.createDataFrame([(f,) for f in screening.redundant(pairs, mi)], "feature string")


@query("b11_feature_screening", f"""WITH {_RANKED}, base AS (SELECT avg(mi) AS b FROM mi WHERE feature LIKE 'noise%'),
  suspects AS ({_each("SELECT '{c}' AS feature, abs(corr({c}, y)) > 0.98 AS leak FROM line", _LINE_FEATURES)}),
  pool AS (SELECT feature, mi FROM mi JOIN suspects USING (feature) WHERE NOT leak),
  t AS (SELECT CASE WHEN (SELECT max(mi) FROM pool) > b THEN b ELSE b * 0.5 END AS threshold FROM base),
  kept AS (SELECT feature, mi FROM pool, t WHERE mi > threshold
    OR (NOT EXISTS (SELECT 1 FROM pool WHERE mi > threshold) AND feature = (SELECT max_by(feature, mi) FROM pool))),
  pairs AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS c FROM line"
    for i, a in enumerate(_LINE_FEATURES) for b in _LINE_FEATURES[i + 1:])}),
  dup AS (SELECT DISTINCT CASE WHEN (round(a.mi, 6), a.feature) < (round(b.mi, 6), b.feature)
      THEN a.feature ELSE b.feature END AS feature
    FROM pairs JOIN kept a ON a.feature = column_a JOIN kept b ON b.feature = column_b WHERE abs(c) >= 0.90)
  SELECT 'flat' AS feature, 'low_variance' AS reason, 'excluded' AS status
  UNION ALL SELECT 'name', 'high_cardinality', 'excluded'
  UNION ALL SELECT s.feature,
    CASE WHEN leak THEN 'leakage_suspect' WHEN k.feature IS NULL THEN 'below_noise_baseline'
         WHEN d.feature IS NOT NULL THEN 'redundant' END,
    CASE WHEN leak OR k.feature IS NULL OR d.feature IS NOT NULL THEN 'excluded' ELSE 'recommended' END
  FROM suspects s LEFT JOIN kept k USING (feature) LEFT JOIN dup d USING (feature)""")
def feature_screening(spark, sf):
    line = line_features(spark, sf).withColumn("flat", F.lit(5.0)).withColumn("name", F.col("k"))
    found = screening.screen_features(
        line, "y", F.col("k"), [*_LINE_FEATURES, "flat"], text=["name"], exact=True
    )
    return found.table(line)


@query("b12_target_candidates", f"""WITH {EV}, v AS (
    SELECT 'y' AS "column", var_samp(y) AS v, corr(y, b) AS s FROM (SELECT y, lag(y) OVER (ORDER BY t_idx) AS b FROM ev)
    UNION ALL SELECT 'x', var_samp(x), corr(x, b) FROM (SELECT x, lag(x) OVER (ORDER BY t_idx) AS b FROM ev))
  SELECT "column", {r("v")} AS variance, {r("s")} AS self_correlation,
         CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM v""")
def target_candidates(spark, sf):
    found = profile.target_candidates(event_series(spark, sf), ["x", "y"])
    return found.withColumns({c: rounded(c) for c in ("variance", "self_correlation")})


@query("b13_frequency", f"""WITH {DAYS}, {EV}, steps AS (
    SELECT 'daily' AS series, (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t_idx))) // 1000000 AS s FROM days
    UNION ALL SELECT 'events', (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t_idx))) // 1000000 FROM ev),
  counted AS (SELECT series, s, count(*) AS n FROM steps WHERE s IS NOT NULL GROUP BY ALL)
  SELECT series, s AS step_seconds, n AS steps FROM counted
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, s) = 1""")
def frequency(spark, sf):
    daily = profile.step_seconds(daily_revenue(spark, sf)).withColumn("series", F.lit("daily"))
    return daily.unionByName(profile.step_seconds(event_series(spark, sf)).withColumn("series", F.lit("events")))


_DAYSUM = """daysum AS (SELECT event_type, CAST(ts AS DATE) AS d, CASE WHEN hour(max(ts)) >= 12 THEN 'pm' ELSE 'am' END
    AS last_half FROM events GROUP BY 1, 2)"""


@query("b14_multiple_series", f"""WITH {_DAYSUM}, rep AS (SELECT count_if(n > 1)::BIGINT AS n FROM (
    SELECT count(*) AS n FROM daysum GROUP BY d))
  SELECT 'event_type' AS "column", rep.n AS repeated_times, c.n AS clashes, rep.n > 0 AND c.n = 0 AS identifies_series
  FROM rep, (SELECT count_if(n > 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM daysum GROUP BY event_type, d)) c
  UNION ALL SELECT 'last_half', rep.n, c.n, rep.n > 0 AND c.n = 0
  FROM rep, (SELECT count_if(n > 1)::BIGINT AS n FROM (SELECT count(*) AS n FROM daysum GROUP BY last_half, d)) c""")
def multiple_series(spark, sf):
    days = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(
        F.when(F.hour(F.max("ts")) >= 12, "pm").otherwise("am").alias("last_half")
    )
    return profile.series_id_check(days, "d", ["event_type", "last_half"])


@query("b15_adf_test")
def adf_test(spark, sf):
    """Level and walk of the event series, per event type, by a dashed name."""
    level = stattests.adf(event_panel(spark, sf), "y", series_cols=["event_type"])
    whole = stattests.adf(event_series(spark, sf), "y").withColumn("event_type", F.lit("all"))
    out = level.unionByName(whole)
    return out.withColumns({c: rounded(c) for c in ("adf_stat", "p_value")})


@query("b15_adf_without_lags", f"""WITH {PANEL}, l AS (SELECT event_type, lag(y) OVER w AS level, y - lag(y) OVER w AS step
    FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY t_idx)),
  f AS (SELECT event_type, count(level) AS n, regr_slope(step, level) AS b, regr_sxx(step, level) AS sxx,
    regr_syy(step, level) - regr_slope(step, level) * regr_sxy(step, level) AS rss FROM l GROUP BY 1)
  SELECT event_type, {r("CASE WHEN n + 1 >= 50 THEN b / sqrt(rss / (n - 2) / sxx) END")} AS adf_stat, 0 AS used_lag, n AS n_obs FROM f""")
def adf_without_lags(spark, sf):
    """Dickey-Fuller statistics per series: a slope over its error."""
    found = stattests.adf(event_panel(spark, sf), "y", max_lag=0, series_cols=["event_type"])
    return found.select("event_type", rounded("adf_stat").alias("adf_stat"), "used_lag", "n_obs")


def acf_sql(src: str, lags: int) -> str:
    """Rows (lag, n, acf) of a CTE with t_idx and y."""
    terms = ", ".join(
        f"sum((y - m) * (lag{k} - m)) / sum((y - m) * (y - m))" for k in range(1, lags + 1)
    )
    lagged = ", ".join(f"lag(y, {k}) OVER (ORDER BY t_idx) AS lag{k}" for k in range(1, lags + 1))
    return f"""(SELECT CAST(unnest(range(1, {lags + 1})) AS INTEGER) AS lag, n,
        unnest([{terms}]) AS acf FROM (SELECT *, avg(y) OVER () AS m, count(*) OVER () AS n, {lagged} FROM {src})
        GROUP BY n)"""


@query("b16_ljung_box", f"""WITH {EV}, a AS {acf_sql("ev", 10)}
  SELECT {r("max(n) * (max(n) + 2) * sum(acf * acf / (n - lag))", 4)} AS q_stat, count(acf) AS lags FROM a""")
def ljung_box(spark, sf):
    curve = stattests.acf(event_series(spark, sf), "y", 10)
    return stattests.ljung_box(curve).select(rounded("q_stat", 4).alias("q_stat"), "lags")


@query("b16_white_noise_flags")
def white_noise_flags(spark, sf):
    """White noise and random walk per event type."""
    from tidecast.plans.forecast import noise_flags

    return noise_flags(event_panel(spark, sf), "y", ["event_type"])


def phase_sql(src: str, period: int, y: str = "y") -> str:
    """One row of seasonal and trend strength for a CTE with t_idx."""
    half = period // 2
    edge = f" - (lag({y}, {half}) OVER (ORDER BY t_idx) + lead({y}, {half}) OVER (ORDER BY t_idx)) / 2" if period % 2 == 0 else ""
    frame = f"OVER (ORDER BY t_idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""(SELECT {period} AS period, count(*) AS "rows",
      greatest(0.0, 1 - var_samp(d - s) / var_samp(d)) AS seasonal_strength,
      greatest(0.0, 1 - var_samp(d - s) / var_samp(v - s)) AS trend_strength
      FROM (SELECT v, d, avg(d) OVER (PARTITION BY t_idx % {period}) AS s FROM (
        SELECT t_idx, {y} AS v, {y} - CASE WHEN count({y}) {frame} = {2 * half + 1}
          THEN (sum({y}) {frame}{edge}) / {period} END AS d FROM {src}) WHERE d IS NOT NULL))"""


@query("b17_components", f"""WITH {SEAS}, s AS (
    SELECT * FROM {phase_sql("seas", 7)} UNION ALL SELECT * FROM {phase_sql("seas", 12)})
  SELECT max(trend_strength) > 0.5 AS trend_detected, max(seasonal_strength) >= 0.2 AS seasonality_detected FROM s""")
def components(spark, sf):
    return seasonality.component_flags(seasonality.strengths(seasonal_series(spark, sf), "y", [7, 12]))


@query("b17_trend_line", f"""WITH {SEAS} SELECT {r("regr_slope(y, t_idx)", 9)} AS slope,
  {r("regr_r2(y, t_idx)")} AS trend_r2 FROM seas""")
def trend_line(spark, sf):
    line = seasonality.trend_line(seasonal_series(spark, sf), "y")
    return line.select(rounded("slope", 9).alias("slope"), rounded("trend_r2").alias("trend_r2"))


@query("b18_autocorrelation", f"""WITH {EV}, a AS {acf_sql("ev", 24)}
  SELECT lag, n, {r("acf")} AS acf FROM a WHERE lag <= n // 4""")
def autocorrelation(spark, sf):
    return stattests.acf(event_series(spark, sf), "y").withColumn("acf", rounded("acf"))


_GAPS = f"""{EV}, gaps AS (SELECT y, row_number() OVER (ORDER BY t_idx) - 1 AS t_idx FROM ev WHERE event_id % 3 <> 0)"""


@query("b18_autocorrelation_with_gaps", f"""WITH {_GAPS}, a AS {acf_sql("gaps", 24)}
  SELECT lag, n, {r("acf")} AS acf FROM a WHERE lag <= n // 4""")
def autocorrelation_with_gaps(spark, sf):
    """Rows without a value are left out, and the rest counts as neighbours."""
    gaps = event_series(spark, sf).withColumn("y", F.when(F.col("event_id") % 3 != 0, F.col("y")))
    return stattests.acf(gaps, "y").withColumn("acf", rounded("acf"))


@query("b18_significant_lags", f"""WITH {SEAS}, a AS {acf_sql("seas", 24)}
  SELECT lag, n, {r("acf")} AS acf FROM a WHERE lag <= n // 4 AND acf > 0.1""")
def significant(spark, sf):
    curve = stattests.acf(seasonal_series(spark, sf), "y")
    return stattests.significant_lags(curve).withColumn("acf", rounded("acf"))


@query("b18_autocorrelation_panel", f"""WITH {PANEL}, l AS (
    SELECT *, avg(y) OVER (PARTITION BY event_type) AS m, count(*) OVER (PARTITION BY event_type) AS n,
      lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3
    FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY t_idx))
  SELECT event_type, CAST(unnest([1, 2, 3]) AS INTEGER) AS lag, n, unnest([{", ".join(
      r(f"sum((y - m) * (l{k} - m)) / sum((y - m) * (y - m))") for k in (1, 2, 3))}]) AS acf
  FROM l GROUP BY event_type, n""")
def autocorrelation_panel(spark, sf):
    curve = stattests.acf(event_panel(spark, sf), "y", 3, ["event_type"])
    return curve.withColumn("acf", rounded("acf"))


_CROSS = f"""WITH {EV}, l AS (SELECT *, {", ".join(f"lag(x, {k}) OVER (ORDER BY t_idx) AS x{k}" for k in range(4))},
    {", ".join(f"lag(z, {k}) OVER (ORDER BY t_idx) AS z{k}" for k in range(4))}
    FROM (SELECT *, lead(y, 2) OVER (ORDER BY t_idx) AS z FROM ev))"""


@query("b19_cross_correlation", f"""{_CROSS} SELECT feature, lag, {r("c")} AS xcorr, abs(c) > 0.15 AS useful FROM ({
    " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS lag, corr(y, {f}{k}) AS c FROM l"
                       for f in "xz" for k in range(4))})""")
def cross_correlation(spark, sf):
    """The second feature runs two rows ahead of the target, so lag 2 stands out."""
    from tidecast.operators.order import over_order

    ahead = over_order(event_series(spark, sf), lambda w: {"z": F.lead("y", 2).over(w)}, behind=0, ahead=2)
    found = stattests.cross_correlation(ahead, ["x", "z"], "y")
    return found.withColumn("xcorr", rounded("xcorr"))


@query("b20_model_families", """
  SELECT user_id, CASE WHEN user_id % 5 = 0 THEN ['Naive', 'Exponential Smoothing']
    WHEN user_id % 3 = 0 THEN ['XGBoost', 'LightGBM']
    WHEN n > 20 THEN ['SARIMA', 'Prophet', 'XGBoost']
    WHEN m > 50 THEN ['Gradient Boosting', 'Linear Regression']
    ELSE ['SARIMA', 'Prophet', 'ETS'] END AS model_recommendations
  FROM (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY user_id)""")
def model_families(spark, sf):
    flags = table(spark, sf, "events").groupBy("user_id").agg(
        (F.count("*") > 20).alias("seasonality_detected"), (F.avg("value") > 50).alias("stationary")
    ).withColumns({"white_noise": F.col("user_id") % 5 == 0, "multiple_series": F.col("user_id") % 3 == 0})
    return seasonality.recommend_families(flags).select("user_id", "model_recommendations")


@query("b21_short_series_guard", """
  SELECT user_id, count(*) < 50 AS too_short FROM events GROUP BY user_id HAVING count(*) >= 4""")
def short_series_guard(spark, sf):
    """ADF over one series per user: short ones get nulls, none fails."""
    from tidecast.operators.order import dense_index

    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("t"), F.col("value").alias("y"))
    tested = stattests.adf(dense_index(rows, ["t", "event_id"], ["user_id"]), "y", 1, ["user_id"])
    return tested.select("user_id", F.col("adf_stat").isNull().alias("too_short"))
