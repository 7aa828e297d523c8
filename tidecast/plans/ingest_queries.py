"""Sources, sinks and cleansing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.names import rename_normalised
from tidecast.operators import cleanse, split
from tidecast.operators.order import join_keys
from tidecast.plans.inputs import DAYS, EV, PANEL, daily_revenue, event_panel, event_series, r, rounded, table
from tidecast.plans.registry import query
from tidecast.sources import files
from tidecast.storage import scratch_path

_ORDER_TEXT = """
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, o_orderstatus AS s
  FROM orders"""


@query("a1_csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, "
       "o_orderpriority FROM orders")
def csv_scan(spark, sf):
    path = files.write_csv(table(spark, sf, "orders"), scratch_path(spark, "orders-csv"))
    typed, _ = cleanse.infer_types(files.scan_csv(spark, path).drop(files.CORRUPT))
    return typed


def _mixed_folder(spark, sf) -> list[str]:
    """Orders as CSV in two folders: with other orders and sets of columns, and lines with a field too many or too few."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    text = {"o_orderkey": key.cast("string"), "o_custkey": F.col("o_custkey").cast("string"),
            "price": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "Status": F.col("o_orderstatus")}
    base, folders = scratch_path(spark, "mixed-csv"), []
    for rest, names in enumerate((["o_orderkey", "o_custkey", "price"], ["Status", "price", "o_orderkey", "o_custkey"])):
        line = F.concat_ws(",", *[text[n] for n in names], F.when(key % 50 == rest, F.lit("extra")))
        line = F.when(key % 77 == rest, text[names[0]]).otherwise(line)
        folder = f"{base}/part={rest} of 2"
        # A separator that no line holds keeps the lines as they are.
        o.where(key % 2 == rest).select(line.alias(",".join(n.upper() if n == "price" and rest else n for n in names))).write.option(
            "header", True).option("sep", "\u0001").csv(folder)
        folders.append(folder)
    return folders


_MIXED = """mixed AS (SELECT o_orderkey % 2 AS half, o_orderkey % 50 = half AS long_line, o_orderkey % 77 = half AS short_line, *,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders WHERE half IN (0, 1))"""
_MIXED_LINE = """CASE WHEN short_line THEN CASE half WHEN 0 THEN o_orderkey::VARCHAR ELSE o_orderstatus END
    WHEN long_line AND half = 0 THEN concat_ws(',', o_orderkey, o_custkey, p, 'extra')
    WHEN long_line THEN concat_ws(',', o_orderstatus, p, o_orderkey, o_custkey, 'extra') END"""


@query("a1_csv_folder_with_other_headers", f"""WITH {_MIXED}
  SELECT CASE WHEN NOT short_line OR half = 0 THEN o_orderkey END AS o_orderkey, CASE WHEN NOT short_line THEN o_custkey END AS o_custkey,
    CASE WHEN NOT short_line THEN CAST(p AS DOUBLE) END AS price, CASE WHEN half = 1 THEN o_orderstatus END AS status,
    {_MIXED_LINE} AS raw_line FROM mixed""")
def csv_folder(spark, sf):
    scan = files.scan_csv(spark, _mixed_folder(spark, sf))
    return scan.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), F.col("price").cast("double").alias("price"),
                       F.col("status"), F.col(files.CORRUPT).alias("raw_line"))


@query("a2_malformed_in_mixed_folder", f"""WITH {_MIXED}
  SELECT {_MIXED_LINE} AS raw_line, CASE WHEN NOT short_line OR half = 0 THEN o_orderkey END AS o_orderkey,
    CASE WHEN NOT short_line THEN o_custkey END AS o_custkey,
    CASE WHEN NOT short_line THEN CAST(p AS DOUBLE) END AS price, CASE WHEN half = 1 THEN o_orderstatus END AS status
  FROM mixed WHERE long_line OR short_line""")
def malformed_in_folder(spark, sf):
    hints = T.StructType.fromDDL("o_custkey bigint, price double, o_orderkey bigint, status string")
    found = files.malformed_rows(files.scan_csv(spark, _mixed_folder(spark, sf), hints))
    return found.select("raw_line", "o_orderkey", "o_custkey", "price", "status")


@query("a2_malformed_rows", f"""
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN k || ',' || c || ',' || p || ',' || s || ',extra'
              ELSE k || ',' || c || ',n/a,' || s END AS raw_line,
         o_orderkey, CAST(c AS BIGINT) AS o_custkey,
         CASE WHEN o_orderkey % 50 = 0 THEN CAST(p AS DOUBLE) END AS o_totalprice, s AS o_orderstatus
  FROM ({_ORDER_TEXT}) WHERE o_orderkey % 50 = 0 OR o_orderkey % 77 = 0""")
def malformed(spark, sf):
    """Orders as CSV with an extra field or a broken number on some lines."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 50 == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    price = F.coalesce(price, F.when(key % 77 == 0, F.lit("n/a")),
                       F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    fields = [key.cast("string"), F.col("o_custkey").cast("string"), price, F.col("o_orderstatus")]
    line = F.concat_ws(",", *fields, F.when(key % 50 == 0, F.lit("extra")))
    path = scratch_path(spark, "broken-csv")
    o.select(line).write.text(path)
    hints = T.StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string"
    )
    reader_schema = T.StructType([*hints.fields, T.StructField(files.CORRUPT, T.StringType())])
    scan = (
        spark.read.schema(reader_schema).option("columnNameOfCorruptRecord", files.CORRUPT)
        .option("columnPruning", False).csv(path)
    )
    return files.malformed_rows(scan)


@query("a3_normalised_names", """
  SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_totalprice AS total_price,
         o_orderstatus AS status FROM orders""")
def normalised(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rename_normalised(o.toDF(" Order Key ", "ORDER__KEY", "Total  Price", "_Status_"))


@query("a4_lenient_types", """
  WITH n AS (SELECT count(*) AS n, count_if(o_orderkey % 10 = 0) AS bad FROM orders)
  SELECT 'order_id' AS "column", 'bigint' AS inferred_type, n AS non_null, 0::BIGINT AS invalid_casts FROM n
  UNION ALL SELECT 'price', 'double', n, CAST(bad AS BIGINT) FROM n
  UNION ALL SELECT 'price_text', 'string', n, 0 FROM n
  UNION ALL SELECT 'discounted', 'double', n, 0 FROM n
  UNION ALL SELECT 'placed', 'timestamp_ntz', n, 0 FROM n""")
def lenient_types(spark, sf):
    price = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        price.alias("price"),
        price.alias("price_text"),
        (F.col("o_totalprice") * 0.9).cast("string").alias("discounted"),
        F.col("o_orderdate").cast("string").alias("placed"),
    )
    return cleanse.infer_types(text, {"price": "double"})[1]


_NULLED = """(SELECT nullif(l_quantity, 10) AS quantity, nullif(l_discount, 0.05) AS discount,
    l_extendedprice AS price, l_returnflag AS flag FROM lineitem)"""


def _nulled(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.expr("nullif(l_quantity, 10)").alias("quantity"),
        F.expr("nullif(l_discount, 0.05D)").alias("discount"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
    )


@query("a5_null_rates", f"""
  WITH w AS (SELECT count(*) AS n, count(*) - count(quantity) AS q, count(*) - count(discount) AS d,
             count(*) - count(price) AS p, count(*) - count(flag) AS f FROM {_NULLED})
  SELECT "column", dtype, {r("nulls / n")} AS null_rate, n AS row_count, 4::BIGINT AS column_count FROM (
    SELECT 'quantity' AS "column", 'double' AS dtype, q AS nulls, n FROM w
    UNION ALL SELECT 'discount', 'double', d, n FROM w UNION ALL SELECT 'price', 'double', p, n FROM w
    UNION ALL SELECT 'flag', 'string', f, n FROM w)""")
def null_rates(spark, sf):
    return cleanse.null_rates(_nulled(spark, sf)).withColumn("null_rate", rounded("null_rate"))


@query("a6_duplicate_rows", """
  SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicates(spark, sf):
    return cleanse.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type"))


@query("a6_duplicate_summary", """
  SELECT count(*) AS repeated_rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (
    SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1)""")
def duplicate_summary(spark, sf):
    return cleanse.duplicate_summary(table(spark, sf, "events").select("user_id", "event_type"))


@query("a6_without_duplicates", "SELECT DISTINCT user_id, event_type FROM events")
def without_duplicates(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").dropDuplicates()


def _outlier_sql(table_name: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"""
      SELECT '{c}' AS "column", {r("max(lo)")} AS low_fence, {r("max(hi)")} AS high_fence,
             count_if({c} < lo OR {c} > hi)::BIGINT AS outliers, count({c}) AS "values"
      FROM {table_name}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
        SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table_name}))"""
                              for c in cols)


@query("a7_outliers", f"""SELECT * FROM ({_outlier_sql("lineitem", ["l_extendedprice", "l_quantity", "l_tax"])}
  UNION ALL {_outlier_sql("events", ["value"])})""")
def outliers(spark, sf):
    line = cleanse.outlier_report(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"]
    )
    both = line.unionByName(cleanse.outlier_report(table(spark, sf, "events"), ["value"]))
    return both.withColumns({c: rounded(c) for c in ("low_fence", "high_fence")})


_HOLED = "(SELECT CASE WHEN event_id % 13 != 0 AND event_id % 17 != 0 THEN value END AS value, NULL::DOUBLE AS nothing FROM events)"


@query("a7_outliers_with_nan", f"""{_outlier_sql(_HOLED, ["value"])}
  UNION ALL SELECT 'nothing', NULL, NULL, 0::BIGINT, 0::BIGINT FROM (SELECT count(*) FROM events)""")
def outliers_with_nan(spark, sf):
    """Some values NaN, some null, and a column of NaN alone."""
    value = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).when(F.col("event_id") % 17 != 0, F.col("value"))
    holed = table(spark, sf, "events").select(value.alias("value"), F.lit(float("nan")).alias("nothing"))
    found = cleanse.outlier_report(holed, ["value", "nothing"])
    return found.withColumns({c: rounded(c) for c in ("low_fence", "high_fence")})


@query("a11_mean_of_training_rows", f"""WITH {PANEL}, g AS (SELECT *, CASE WHEN event_id % 5 != 0 THEN y END AS v,
    t_idx < floor(0.8 * count(*) OVER (PARTITION BY event_type)) AS train FROM panel)
  SELECT event_type, event_id, {r("coalesce(v, avg(v) FILTER (train) OVER (PARTITION BY event_type))")} AS y FROM g""")
def mean_of_training_rows(spark, sf):
    """A fifth of the values missing (some as NaN), each filled with its own series' mean before the holdout."""
    panel = event_panel(spark, sf)
    firsts = panel.groupBy("event_type").agg(F.floor(0.8 * (F.max("t_idx") + 1)).alias("first"))
    holed = F.when(F.col("event_id") % 5 != 0, F.col("y")).when(F.col("event_id") % 10 == 0, F.lit(float("nan")))
    marked = join_keys(panel, firsts, ["event_type"]).withColumn("y", holed)
    filled = cleanse.fill_nulls(marked, "y", "mean", series_cols=["event_type"], fitted_on=F.col("t_idx") < F.col("first"))
    return filled.select("event_type", "event_id", rounded("y").alias("y"))


@query("a8_time_column", f"""
  SELECT 'day' AS "column", 1.0::DOUBLE AS time_share,
         {r("count(DISTINCT date_trunc('day', ts)) / count(*)")} AS distinct_ratio, false AS chosen FROM events
  UNION ALL SELECT 'event_type', 0.0, NULL, false
  UNION ALL SELECT 'stamp', 1.0, {r("count(DISTINCT ts) / count(*)")}, true FROM events
  UNION ALL SELECT 'props', 0.0, NULL, false""")
def time_column(spark, sf):
    text = table(spark, sf, "events").select(
        F.col("ts").cast("date").cast("string").alias("day"), "event_type",
        F.col("ts").cast("string").alias("stamp"), "props", "event_id",
    )
    return cleanse.time_column_candidates(text).withColumn("distinct_ratio", rounded("distinct_ratio"))


@query("a9_target_validation", """
  SELECT 'tax' AS target_column, count(*) AS row_count_before,
         count_if(l_tax = 0)::BIGINT AS null_targets, count_if(l_tax <> 0)::BIGINT AS row_count_after
  FROM lineitem""")
def target_validation(spark, sf):
    line = table(spark, sf, "lineitem").select(F.expr("nullif(l_tax, 0D)").alias("tax"), "l_quantity")
    return cleanse.validate_target(line, "tax")[1]


@query("a10_row_accounting", """
  WITH w AS (SELECT count(*) AS a, count_if(l_tax <> 0)::BIGINT AS b, count_if(l_tax <> 0 AND l_quantity <= 45)::BIGINT AS c,
    count_if(l_tax <> 0 AND l_quantity <= 45 AND l_returnflag <> 'R')::BIGINT AS d FROM lineitem)
  SELECT 1 AS stage_no, 'target' AS stage, a AS rows_in, b::BIGINT AS rows_out, 'null target' AS reason FROM w
  UNION ALL SELECT 2, 'quantity', b, c, 'quantity above 45' FROM w
  UNION ALL SELECT 3, 'returns', c, d, 'returned item' FROM w""")
def row_accounting(spark, sf):
    stages = [
        ("target", F.expr("nullif(l_tax, 0D)").isNotNull(), "null target"),
        ("quantity", F.col("l_quantity") <= 45, "quantity above 45"),
        ("returns", F.col("l_returnflag") != "R", "returned item"),
    ]
    return cleanse.accounted_filters(table(spark, sf, "lineitem"), stages)[1]


@query("a11_null_handling", f"""
  WITH {EV}, g AS (SELECT event_id, t_idx, CASE WHEN y >= 60 THEN y END AS y FROM ev)
  SELECT event_id, coalesce(y, -1.0) AS by_constant,
         {r("coalesce(y, avg(y) OVER ())")} AS by_mean,
         last_value(y IGNORE NULLS) OVER (ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS by_forward
  FROM g""")
def null_handling(spark, sf):
    """Small values blanked out, then treated in three ways."""
    gaps = event_series(spark, sf).select(
        "event_id", "t_idx", F.when(F.col("y") >= 60, F.col("y")).alias("y")
    )
    filled = cleanse.fill_nulls(gaps, "y", "constant", -1.0, out="by_constant")
    filled = cleanse.fill_nulls(filled, "y", "mean", out="by_mean")
    filled = cleanse.fill_nulls(filled, "y", "forward", out="by_forward")
    return filled.select("event_id", "by_constant", rounded("by_mean").alias("by_mean"), "by_forward")


@query("a11_null_drop", "SELECT event_id, value AS y FROM events WHERE value >= 60")
def null_drop(spark, sf):
    gaps = table(spark, sf, "events").select("event_id", F.expr("if(value >= 60, value, null)").alias("y"))
    return cleanse.fill_nulls(gaps, "y", "drop")


@query("a12_parquet_round_trip", """
  SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25""")
def parquet_round_trip(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    path = files.write_parquet(line, scratch_path(spark, "cleaned"))
    kept = spark.read.parquet(path).where("l_quantity > 25")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("a13_forecast_csv", f"""
  WITH {DAYS} SELECT CAST(t_idx + 1 AS INTEGER) AS step, y AS forecasted_value FROM days""")
def forecast_csv(spark, sf):
    forecast = daily_revenue(spark, sf).select(
        (F.col("t_idx") + 1).cast("int").alias("step"), F.col("y").alias("forecasted_value")
    )
    path = files.write_csv(forecast, scratch_path(spark, "forecast-csv"))
    hints = T.StructType.fromDDL("step int, forecasted_value double")
    return files.scan_csv(spark, path, hints).drop(files.CORRUPT)


@query("a14_json_records", f"""
  SELECT event_type, count(*) AS n, {r("avg(value)")} AS mean, CAST(NULL AS DOUBLE) AS ratio,
         strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest
  FROM events GROUP BY event_type""")
def json_records(spark, sf):
    """Records with a time and a number that is not finite."""
    stats = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"),
        F.lit(float("nan")).alias("ratio"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"),
    )
    path = files.write_json(stats, scratch_path(spark, "records-json"))
    schema = T.StructType.fromDDL("event_type string, n bigint, mean double, ratio double, latest string")
    return files.read_json(spark, path, schema)


@query("a15_holdout_table", f"""
  WITH {EV} SELECT t_idx, x, y AS label FROM ev WHERE t_idx >= (SELECT floor(0.8 * count(*)) FROM ev)""")
def holdout_table(spark, sf):
    series = event_series(spark, sf).select("t_idx", "x", F.col("y").alias("label"))
    _, holdout = split.chronological(series)
    return spark.read.parquet(files.write_parquet(holdout, scratch_path(spark, "holdout")))
