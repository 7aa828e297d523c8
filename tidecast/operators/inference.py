"""Scoring, forecasting ahead, explaining and listing results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from random import Random

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.names import long_form
from tidecast.operators.features import Feature, build
from tidecast.operators.order import join_keys, over_order
from tidecast.storage import scratch_path, written_table

TOP = 15
BENCHMARKS = ["arima_benchmark", "kmeans_benchmark", "naive_persistence"]
_WRITE_EVERY = 10
_RING_STEPS = 2


def dot(weights: Sequence[float], cols: Sequence[Column | str], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for w, c in zip(weights, cols):
        total = total + F.lit(float(w)) * (F.col(c) if isinstance(c, str) else c)
    return total


def with_residuals(scored: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    return scored.withColumn("residual", F.col(y) - F.col(p))


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Actual, predicted and residual, one map over the rows."""
    return with_residuals(model.transform(rows))


def last_values(df: DataFrame, count: int, col: str = "y", series_cols: Sequence[str] = ()) -> DataFrame:
    """The last ``count`` values of each series, oldest first, in one array."""
    keys = list(series_cols)
    lagged = over_order(
        df.select(*keys, "t_idx", col),
        lambda w: {"_tail": F.array(*[F.lag(col, k).over(w) for k in range(count - 1, 0, -1)], F.col(col))},
        behind=max(count - 1, 1), series_cols=keys,
    )
    return lagged.groupBy(*keys).agg(F.max_by("_tail", "t_idx").alias("tail"))


def forecast_linear_lags(
    tails: DataFrame, lags: Sequence[int], weights: Sequence[float], intercept: float, k: int,
    series_cols: Sequence[str] = (),
) -> DataFrame:
    """k steps of a linear model on lags, each step fed back into its named lag.

    ``tails`` holds an array of recent values per series, as long as the longest lag.
    """
    most = max(lags)

    def step(state: Column, _: Column) -> Column:
        value = F.lit(float(intercept))
        for lag, w in zip(lags, weights):
            value = value + F.lit(float(w)) * F.element_at(state, -lag)
        return F.concat(state, F.array(value))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.col("tail"), step)
    return tails.select(
        *series_cols, F.posexplode(F.slice(grown, F.size("tail") + 1, k)).alias("pos", "forecasted_value")
    ).select(*series_cols, (F.col("pos") + 1).alias("step"), "forecasted_value")


def forecast_linear_roll(
    last_rows: DataFrame, weights: Sequence[float], intercept: float, k: int, series_cols: Sequence[str] = ()
) -> DataFrame:
    """k steps of a linear model by the shifting rule.

    The whole feature vector ``x`` moves one place left and the prediction
    takes the last place, whatever the columns mean.
    """
    w = F.array(*[F.lit(float(v)) for v in weights])

    def step(state: Column, _: Column) -> Column:
        # The window of live features is the tail of a growing array.
        live = F.slice(state, -len(weights), len(weights))
        value = F.aggregate(F.zip_with(live, w, lambda a, b: a * b), F.lit(float(intercept)), lambda a, b: a + b)
        return F.concat(state, F.array(value))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.col("x"), step)
    return last_rows.select(
        *series_cols, F.posexplode(F.slice(grown, len(weights) + 1, k)).alias("pos", "forecasted_value")
    ).select(*series_cols, (F.col("pos") + 1).alias("step"), "forecasted_value")


def forecast_roll(
    model: PipelineModel, last_rows: DataFrame, features: Sequence[str], k: int, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The shifting rule for any model: one row per series through k transforms."""
    keys, features = list(series_cols), list(features)
    state = last_rows.select(*keys, *features).withColumn("_out", F.array().cast("array<double>"))
    for i in range(1, k + 1):
        scored = model.transform(state)
        moved = [F.col(b).alias(a) for a, b in zip(features, features[1:])]
        state = scored.select(
            *keys, *moved, F.col("prediction").alias(features[-1]),
            F.concat("_out", F.array("prediction")).alias("_out"),
        )
        if i % _WRITE_EVERY == 0:
            state = written_table(state, "forecast")
    return state.select(*keys, F.posexplode("_out").alias("pos", "forecasted_value")).select(
        *keys, (F.col("pos") + 1).alias("step"), "forecasted_value"
    )


@dataclass(frozen=True)
class FixedLinear:
    """A linear model with given weights, for ``transform`` like a fitted one."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", dot(self.weights, self.features, self.intercept))


def forecast_recursive(
    model: PipelineModel | FixedLinear,
    df: DataFrame,
    plan: Sequence[Feature],
    k: int,
    step_seconds: int,
    series_cols: Sequence[str] = (),
    sources: Sequence[str] = (),
    future: DataFrame | None = None,
) -> DataFrame:
    """k steps of any model with its features rebuilt from the predictions so far.

    ``future`` has what is known ahead of the ``sources``: series columns,
    ``step`` (from 1) and any of the sources, one row a series and step.  A
    source, or a value of it, that is not known ahead keeps its last value.

    All series advance together on a ring of the rows that the longest look-back
    needs.  Each step reads the ring twice, so every second step is written out;
    what is read and written grows with k, not with its square.
    """
    spark, keys, sources = df.sparkSession, list(series_cols), list(sources)
    reach = max(max((f.farthest for f in plan), default=1), _RING_STEPS)
    ends = df.groupBy(*keys).agg(F.max("t_idx").alias("_end"))
    if keys:
        recent = join_keys(df, ends, keys).where(F.col("t_idx") > F.col("_end") - reach)
    else:
        end = F.lit(ends.first()[0])
        recent = df.where(F.col("t_idx") > end - reach).withColumn("_end", end)
    ring = written_table(recent.select(
        *keys, "t", "y", "t_idx", *sources, (F.col("t_idx") - F.col("_end")).alias("_step")), "ring")
    known = [s for s in sources if future is not None and s in future.columns]
    if known:
        future = written_table(future.select(*keys, F.col("step").cast("long").alias("_step"), *[F.col(s).alias(f"_next_{s}") for s in known]), "future")
    paths = []
    for i in range(1, k + 1):
        following = ring.where(F.col("_step") == i - 1).select(
            *keys, (F.col("t") + F.make_dt_interval(secs=F.lit(step_seconds))).alias("t"),
            F.lit(None).cast("double").alias("y"), (F.col("t_idx") + 1).alias("t_idx"), *sources, F.lit(i).cast("long").alias("_step"),
        )
        if known:
            following = join_keys(following, future.where(F.col("_step") == i), [*keys, "_step"], "left").withColumns(
                {s: F.coalesce(f"_next_{s}", s) for s in known}).drop(*[f"_next_{s}" for s in known])
        built = build(ring.unionByName(following), plan, keys).where(F.col("_step") == i)
        predicted = model.transform(built).select(*keys, "t", F.col("prediction").alias("y"), "t_idx", *sources, "_step")
        ring = ring.where(F.col("_step") > i - reach).unionByName(predicted)
        if i % _RING_STEPS == 0 or i == k:
            paths.append(scratch_path(spark, "ring"))
            fresh = F.col("_step") > max(i - (i % _RING_STEPS or _RING_STEPS), 0)
            ring.withColumn("_fresh", fresh).write.parquet(paths[-1])
            ring = spark.read.schema(ring.schema).parquet(paths[-1])
    if not paths:
        return ring.where("_step > 0").select(*keys, F.col("_step").cast("int").alias("step"), F.col("y").alias("forecasted_value"))
    written = T.StructType([*ring.schema.fields, T.StructField("_fresh", T.BooleanType())])
    return spark.read.schema(written).parquet(*paths).where("_fresh").select(
        *keys, F.col("_step").cast("int").alias("step"), F.col("y").alias("forecasted_value"))


def forecast_summary(forecast: DataFrame, historical_mean: float) -> DataFrame:
    return forecast.agg(
        F.count("*").alias("forecast_length"),
        F.avg("forecasted_value").alias("forecast_mean"),
        (F.max("forecasted_value") - F.min("forecasted_value")).alias("forecast_range"),
        (F.avg("forecasted_value") - F.lit(historical_mean)).alias("vs_historical_mean"),
    )


def importance(model: PipelineModel, features: Sequence[str], spark, top: int = TOP) -> DataFrame:
    """Importances of trees or coefficients of linear models, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        kind, values = "importance", last.featureImportances.toArray()
    else:
        kind, values = "coefficient", last.coefficients.toArray()
    rows = sorted(zip(features, (float(v) for v in values)), key=lambda x: (-abs(x[1]), x[0]))[:top]
    return spark.createDataFrame(
        [(f, kind, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, kind string, value double, rank int"
    )


def first_rows(df: DataFrame, count: int, order: str = "t_idx") -> DataFrame:
    """The first rows by position: the sample an explanation is asked for."""
    return df.orderBy(order).limit(count)


def linear_attributions(
    rows: DataFrame, features: Sequence[str], weights: Sequence[float], background: DataFrame, row_id: str = "t_idx"
) -> DataFrame:
    """Exact Shapley values of a linear model: weight times distance from the background mean."""
    mean = background.agg(*[F.avg(f).alias(f) for f in features]).first()
    entries = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(f) - F.lit(mean[f]))).alias("shap"),
        )
        for f, w in zip(features, weights)
    ])
    return rows.select(F.col(row_id).alias("row_id"), F.inline(entries))


def sampled_attributions(
    model: PipelineModel, rows: DataFrame, features: Sequence[str], background: DataFrame,
    row_id: str = "t_idx", permutations: int = 20, seed: int = 42,
) -> DataFrame:
    """Shapley values of any model by permutation sampling.

    Each row is scored with growing prefixes of a permutation taken from the
    row and the rest from a background row; the steps between prefixes are the
    contributions.  All mixes are scored in one transform.  ``permutations`` is
    rounded up to a multiple of the background rows.
    """
    features = list(features)
    n, rng = len(features), Random(seed)
    # At most as many background rows as the caller passes (20 by default).
    base = background.select(*[F.col(f).alias(f"_b_{f}") for f in features]).withColumn(
        "_b", F.row_number().over(Window.partitionBy().orderBy(*[f"_b_{f}" for f in features])) - 1
    )
    count = base.count()
    permutations = -(-permutations // max(count, 1)) * max(count, 1)  # every background row serves equally often
    places = []
    for _ in range(permutations):
        order = list(range(n))
        rng.shuffle(order)
        place = [0] * n
        for position, i in enumerate(order):
            place[i] = position
        places.append(place)
    place_of = F.array(*[F.array(*[F.lit(p) for p in place]) for place in places])
    mixed = (
        rows.select(F.col(row_id).alias("row_id"), *features)
        .withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("_b", F.pmod("_perm", F.lit(count)))
        .join(base, "_b")
        .withColumn("_places", F.element_at(place_of, F.col("_perm") + 1))
        .withColumn("_prefix", F.explode(F.sequence(F.lit(0), F.lit(n))))
    )
    taken = {
        f: F.when(F.element_at("_places", i + 1) < F.col("_prefix"), F.col(f)).otherwise(F.col(f"_b_{f}"))
        for i, f in enumerate(features)
    }
    own = mixed.select(
        "row_id", "_perm", "_prefix", "_places", *[c.alias(f) for f, c in taken.items()],
        F.array(*[F.col(f).cast("double") for f in features]).alias("_own"),
    )
    scored = model.transform(own)
    before = F.lag("prediction").over(Window.partitionBy("row_id", "_perm").orderBy("_prefix"))
    steps = scored.select(
        "row_id", "_own", (F.col("prediction") - before).alias("_gain"),
        F.array_position("_places", F.col("_prefix") - 1).cast("int").alias("_feature"),
    ).where("_gain is not null")
    names = F.array(*[F.lit(f) for f in features])
    return steps.groupBy("row_id", F.element_at(names, F.col("_feature")).alias("feature")).agg(
        F.first(F.element_at("_own", F.col("_feature"))).alias("value"), F.avg("_gain").alias("shap")
    )


def attribution_ranking(shap: DataFrame, top: int = TOP) -> DataFrame:
    """Mean absolute attribution per feature, the largest ``top``."""
    per_feature = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_shap"))
    return per_feature.orderBy(F.round("mean_shap", 9).desc(), "feature").limit(top)


def attribution_summary(shap: DataFrame) -> DataFrame:
    per_feature = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_shap"))
    return per_feature.agg(
        F.avg("mean_shap").alias("overall_mean"), F.max("mean_shap").alias("overall_max"),
        F.max_by("feature", "mean_shap").alias("most_important"),
    )


def contributions(shap: DataFrame, row: int, top: int = TOP) -> DataFrame:
    """Largest contributions to one prediction."""
    one = shap.where(F.col("row_id") == row).withColumn("abs_shap", F.abs("shap"))
    return one.select("feature", "value", "shap", "abs_shap").orderBy(
        F.round("abs_shap", 9).desc(), "feature"
    ).limit(top)


def feature_statistics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation, minimum and maximum per feature."""
    parts: dict[str, Callable] = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    wide = df.agg(*[f(c).cast("double").alias(f"{c}|{p}") for c in features for p, f in parts.items()])
    return long_form(wide, {c: {p: f"{c}|{p}" for p in parts} for c in features}, "feature")


def comparison_table(candidates: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Candidates and benchmarks under common names, benchmarks first, then by rising R2.

    A benchmark already among the candidates is not repeated; rows without R2
    are left out; the best candidate is marked.
    """
    def common(df: DataFrame) -> DataFrame:
        def either(name: str) -> Column:
            have = [F.col(c) for c in (f"holdout_{name}", name) if c in df.columns]
            return F.coalesce(*have).alias(name)

        return df.select("model", either("r2"), either("rmse"), either("mae"))

    listed = common(candidates)
    extra = common(benchmarks).join(listed, "model", "left_anti")
    rows = listed.unionByName(extra).where("r2 is not null")
    rows = rows.withColumn("is_benchmark", F.col("model").isin(BENCHMARKS))
    # A handful of models per run.
    whole = Window.partitionBy()
    contender = F.when(~F.col("is_benchmark"), F.struct(F.round("r2", 9), "model"))
    best = F.max(contender).over(whole)
    place = Window.partitionBy().orderBy(
        F.desc("is_benchmark"), F.when(F.col("is_benchmark"), F.col("model")), F.round("r2", 9), "model"
    )
    return rows.select(
        "model", "r2", "rmse", "mae", "is_benchmark",
        F.coalesce(best["model"] == F.col("model"), F.lit(False)).alias("is_best"),
        F.row_number().over(place).alias("position"),
    )


def run_catalogue(runs: DataFrame) -> DataFrame:
    """Runs that have a model, newest first."""
    return runs.where("has_model").orderBy(F.desc("run_id"))
