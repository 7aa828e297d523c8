"""Series and tables the queries start from, and the same in SQL.

An indexed series is a written table.  Queries of one session share it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.order import dense_index

_shared: dict[tuple, DataFrame] = {}


def shared(fn):
    @wraps(fn)
    def once(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf, fn.__name__)
        if key not in _shared:
            _shared[key] = fn(spark, sf)
        return _shared[key]

    return once


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@shared
def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series: ``t``, ``t_idx``, ``y`` and a second signal ``x``."""
    events = table(spark, sf, "events")
    rows = events.select(
        "event_id", F.col("ts").alias("t"), "event_type", "user_id", F.col("value").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("x"),
    )
    return dense_index(rows, ["t", "event_id"])


EV = """ev AS (
  SELECT event_id, ts AS t, event_type, user_id, value AS y,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x,
         row_number() OVER (ORDER BY ts, event_id) - 1 AS t_idx
  FROM events)"""


@shared
def event_panel(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type."""
    rows = table(spark, sf, "events").select(
        "event_type", "event_id", F.col("ts").alias("t"), F.col("value").alias("y")
    )
    return dense_index(rows, ["t", "event_id"], ["event_type"])


PANEL = """panel AS (
  SELECT event_type, event_id, ts AS t, value AS y,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t_idx
  FROM events)"""


@shared
def daily_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per order day, summed exactly."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    days = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("d"))
        .agg(F.sum(price).cast("double").alias("y"))
        .select(F.col("d").cast("timestamp_ntz").alias("t"), "y")
    )
    return dense_index(days, ["t"])


DAYS = """days AS (
  SELECT t, y, row_number() OVER (ORDER BY t) - 1 AS t_idx FROM (
    SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
    FROM orders GROUP BY 1))"""


@shared
def seasonal_series(spark: SparkSession, sf: str) -> DataFrame:
    """The event series with a wave of 7 rows and a levelling trend added, so models can learn."""
    wave = 3 * F.sin(F.lit(2 * 3.141592653589793) * F.col("t_idx") / 7)
    trend = F.lit(2.0) * F.col("t_idx") / (F.col("t_idx") + F.lit(1000.0))
    return event_series(spark, sf).select(
        "event_id", "t", "t_idx", "x", (F.col("y") / 100 + wave + trend).alias("y")
    )


SEAS = EV + """, seas AS (
  SELECT event_id, t, t_idx, x,
         y / 100 + 3 * sin(2 * 3.141592653589793 * t_idx / 7) + 2.0::DOUBLE * t_idx / (t_idx + 1000.0::DOUBLE) AS y
  FROM ev)"""


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0 into 0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
