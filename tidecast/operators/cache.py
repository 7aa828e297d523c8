"""Feature tables that are built once for the same input, plan and code."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidecast.operators import features as feature_code
from tidecast.operators import order as order_code
from tidecast.operators.features import Feature, build
from tidecast.storage import publish, published, scratch_path, shared_folder


def content_hash(df: DataFrame) -> str:
    """Of all rows, whatever their order: one pass of two hashes a row, summed exactly."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    exact = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2)]
    sums = df.agg(F.count("*"), *exact).first()
    return "|".join([df.schema.json(), *map(str, sums)])


def plan_hash(plan: Sequence[Feature], series_cols: Sequence[str]) -> str:
    """Of names, reaches and expressions, and of the code that runs them."""
    window = Window.partitionBy(*series_cols, "_stretch").orderBy("t_idx")
    said = [f"{f.name}|{f.nearest}|{f.farthest}|{f.tags}|{f.make(window)}" for f in plan]
    return "\n".join([*said, *series_cols, inspect.getsource(feature_code), inspect.getsource(order_code)])


@dataclass
class CachedFeatures:
    table: DataFrame
    rows_read: int  # rows of the input that were turned into features; 0 when the table was there


def cached_features(df: DataFrame, plan: Sequence[Feature], series_cols: Sequence[str] = (), folder: str | None = None) -> CachedFeatures:
    """Features of ``df``, from the shared folder if the same were built before, by any session.

    Another value in one row, another plan or other code makes another table.
    A table counts once it is written whole; of two built at once either serves.
    Finding out costs one pass of hashes over the input.
    """
    spark = df.sparkSession
    catalogue = f"{folder or shared_folder(spark)}/feature-tables"
    key = hashlib.sha256(f"{content_hash(df)}\n{plan_hash(plan, series_cols)}".encode()).hexdigest()
    entry = published(spark, catalogue, ["key", "path"]).where(F.col("key") == key).agg(F.min("path")).first()[0]
    if entry:
        return CachedFeatures(spark.read.parquet(entry), 0)
    path, seen = scratch_path(spark, "features"), Observation()
    build(df.observe(seen, F.count(F.lit(1)).alias("rows")), plan, series_cols).write.parquet(path)
    publish(spark, catalogue, {"key": key, "path": path})
    return CachedFeatures(spark.read.parquet(path), seen.get["rows"])
