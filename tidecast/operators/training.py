"""Candidate models, causal cross-validation, search and the result table.

Fits run side by side from driver threads over one persisted feature table.
The driver only ever holds one row per model, parameter set and fold.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import boosting, huber, metrics, trees
from tidecast.operators.split import Fold

SEED = 42
Stages = Callable[[DataFrame, list[str], dict], list[Estimator | Transformer]]
# Of rows, features, and pairs of parameters and the end of the training rows (none: all of them).
Together = Callable[[DataFrame, list[str], Sequence[tuple[dict, int | None]]], list[PipelineModel]]


def _assembled(estimator) -> Stages:
    def make(train: DataFrame, features: list[str], params: dict):
        return [
            VectorAssembler(inputCols=features, outputCol="_x"),
            estimator(featuresCol="_x", labelCol="y", **params),
        ]

    return make


def _linear(mix: float):
    """Columns are standardised inside the fit, on its own training rows."""
    def make(regParam: float = 0.1, **kw):
        return LinearRegression(elasticNetParam=mix, regParam=regParam, maxIter=50, **kw)

    return _assembled(make)


class RandomWaves(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Cosines of weighted sums of scaled columns, for a batch of rows at a time.

    A wave is ``cos(shift + sum(weight * (column - mean) / scale))``.  All numbers are
    parameters, so the stage survives saving.
    """

    means = Param(Params._dummy(), "means", "of each column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "of each column", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "of each wave", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "of each wave, by column", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, means=None, scales=None, shifts=None, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        means, scales = self.getOrDefault("means"), self.getOrDefault("scales")
        shifts, weights = np.array(self.getOrDefault("shifts")), np.array(self.getOrDefault("weights"))

        def waves(*columns: pa.Array) -> pa.Array:
            total = np.tile(shifts, (len(columns[0]), 1))
            for j, c in enumerate(columns):
                z = (c.to_numpy(zero_copy_only=False) - means[j]) / scales[j]
                total += z[:, None] * weights[:, j]
            if not np.isfinite(total).all():
                raise ValueError("null, NaN or infinite values in the columns of waves")
            ends = np.arange(0, total.size + 1, len(shifts), dtype=np.int32)
            return pa.ListArray.from_arrays(ends, np.cos(total).ravel())

        columns = [F.col(f"`{c}`").cast("double") for c in self.getInputCols()]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.arrow_udf(waves, "array<double>")(*columns)))


def _kernel(rows: DataFrame, features: list[str], sets: Sequence[tuple[dict, int | None]]) -> list[PipelineModel]:
    """Random Fourier features of an RBF kernel, then a Huber regression; all sets by the same passes.

    Weights come from a seeded generator, means and scales from the training rows.
    """
    spark, ends = rows.sparkSession, list(dict.fromkeys(end for _, end in sets))
    until = lambda end: rows if end is None else rows.where(F.col("t_idx") < end)
    aggregates = [f(c).alias(f"{c}|{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    moments = dict(zip(ends, in_parallel([lambda end=end: until(end).agg(*aggregates).first() for end in ends], spark)))
    fits = []
    for params, end in sets:
        count, width = params.get("components", 32), params.get("width", 1.0)
        rng = np.random.default_rng(SEED)
        weights = rng.normal(scale=1 / (width * np.sqrt(len(features))), size=(count, len(features)))
        shifts = rng.uniform(0, 2 * np.pi, size=count)
        fits.append(huber.Waves(
            np.array([float(moments[end][f"{c}|m"] or 0.0) for c in features]), np.array([float(moments[end][f"{c}|s"] or 1.0) for c in features]),
            shifts, weights, float("inf") if end is None else end))
    penalties = [params.get("regParam", 0.01) for params, _ in sets]
    # Rows of a single set that covers all of them need no index.
    index = F.col("t_idx") if any(end is not None for end in ends) else F.lit(0)
    last = until(None if None in ends else max(ends)).select(index.alias("t_idx"), "y", *features)
    blocks = huber.packed(last, ["t_idx", "y", *features], "waves")
    try:
        lines = huber.fit_lines(blocks, fits, penalties)
    finally:
        blocks.unpersist()
    models = []
    for (_, end), waves, penalty, line in zip(sets, fits, penalties, lines):
        stages = [
            RandomWaves(inputCols=features, outputCol="_waves", means=waves.means.tolist(), scales=waves.scales.tolist(),
                        shifts=waves.shifts.tolist(), weights=waves.weights.tolist()),
            VectorAssembler(inputCols=["_waves", *features], outputCol="_x"),
        ]
        last_stage = LinearRegression(featuresCol="_x", labelCol="y", loss="huber", regParam=penalty, maxIter=50)
        models.append(Pipeline(stages=[*stages, last_stage]).fit(until(end)) if line is None else PipelineModel(
            [*stages, _line_model(spark, last_stage, line)]))
    return models


def _boost(rows: DataFrame, features: list[str], sets: Sequence[tuple[dict, int | None]]) -> list:
    """Boosted trees; all sets by the same passes.  Sets that end early give scorers, the others Spark's own models."""
    spark, estimators = rows.sparkSession, [GBTRegressor(featuresCol="_x", labelCol="y", seed=SEED, **p) for p, _ in sets]
    found = boosting.fit_boosted(rows, features, sets, SEED, lambda jobs: in_parallel(jobs, spark))
    return [b if end is not None else PipelineModel([VectorAssembler(inputCols=features, outputCol="_x"), b.model(spark, e)])
            for b, e, (_, end) in zip(found, estimators, sets)]


def _line_model(spark, estimator: LinearRegression, line: huber.Line):
    """The model that ``estimator`` would have given, from a line found elsewhere."""
    slopes = _py2java(spark.sparkContext, Vectors.dense(line.slopes))
    found = spark.sparkContext._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        estimator.uid, slopes, float(line.intercept), float(line.scale))
    return estimator._copyValues(estimator._create_model(found))


@dataclass(frozen=True)
class Candidate:
    name: str
    stages: Stages | None
    grid: dict[str, list] = field(default_factory=dict)
    forest: bool = False  # its fit, cut at a smaller maxDepth, is the fit of that depth
    together: Together | None = None  # in place of stages: fits many sets by the same passes


def _forest(**kw):
    return RandomForestRegressor(seed=SEED, **kw)


def _extra(**kw):
    return RandomForestRegressor(seed=SEED, bootstrap=False, featureSubsetStrategy="sqrt", **kw)


CANDIDATES = {
    c.name: c
    for c in [
        Candidate("ridge", _linear(0.0), {"regParam": [0.01, 0.1, 1.0]}),
        Candidate("lasso", _linear(1.0), {"regParam": [0.001, 0.01, 0.1]}),
        Candidate("elastic_net", _linear(0.5), {"regParam": [0.001, 0.01, 0.1]}),
        Candidate("gradient_boosting", None, {"maxDepth": [3, 5], "maxIter": [20], "stepSize": [0.1, 0.2]}, together=_boost),
        Candidate("hist_gradient_boosting", None, {"maxDepth": [5], "maxBins": [64], "maxIter": [20]}, together=_boost),
        Candidate("random_forest", _assembled(_forest), {"maxDepth": [5, 8], "numTrees": [30]}, forest=True),
        Candidate("extra_trees", _assembled(_extra), {"maxDepth": [5, 8], "numTrees": [30]}, forest=True),
        Candidate("rbf_kernel", None, {"width": [1.0, 2.0]}, together=_kernel),
    ]
}

# Simpler models come first on equal scores.
COMPLEXITY = ["ridge", "lasso", "elastic_net", "hist_gradient_boosting", "random_forest", "extra_trees",
              "gradient_boosting", "rbf_kernel", "xgboost"]

# Families of the menu that have no counterpart here.
UNAVAILABLE = {
    "xgboost": "library not installed", "lightgbm": "library not installed", "mlp": "no neural regressor in Spark ML",
}


def parameter_sets(grid: dict[str, list], tries: int | None = None) -> list[dict]:
    """The whole grid, or with ``tries`` a random search: so many sets of it, drawn with a fixed seed."""
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]
    return sets if tries is None else Random(SEED).sample(sets, min(tries, len(sets)))


def fit(candidate: Candidate, train: DataFrame, features: list[str], params: dict) -> PipelineModel:
    if candidate.together:
        return candidate.together(train, features, [(params, None)])[0]
    return Pipeline(stages=candidate.stages(train, features, params)).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> dict:
    scored = model.transform(rows).select("y", "prediction")
    return metrics.evaluate(scored, by=()).first().asDict()


def score_depths(model: PipelineModel, rows: DataFrame, features: Sequence[str], depths: Sequence[int]) -> list[dict]:
    """Scores of a forest cut at each of ``depths``, and last of the whole forest, by one pass over the rows."""
    cut = trees.cut_predictions(model, depths)(*[F.col(f"`{c}`").cast("double") for c in features])
    scored = model.transform(rows).select("y", F.posexplode(F.concat(cut, F.array("prediction"))).alias("at", "prediction"))
    found = {m["at"]: m.asDict() for m in metrics.evaluate(scored, by=("at",)).collect()}
    return [found[i] if i in found else score(model, rows) for i in range(len(depths) + 1)]


LEVEL_BYTES = 256 * 2**20  # maxMemoryInMB, as preset: the nodes of a level are split together within it


def shared_fits(candidate: Candidate, features: Sequence[str], params_list: Sequence[dict]) -> list[list[dict]]:
    """Parameter sets by the fit that gives them; the set that is fitted comes last.

    Forests that differ in depth only draw the same rows and columns, level by level, as long
    as each level is split at once.  The shallower ones are the upper levels of the deepest.
    """
    if not candidate.forest:
        return [[p] for p in params_list]
    groups: dict[str, list[dict]] = {}
    for p in params_list:
        nodes = p.get("numTrees", 20) * 2 ** (p.get("maxDepth", 5) - 1)
        whole = nodes * len(features) * p.get("maxBins", 32) * 3 * 8 <= LEVEL_BYTES
        rest = {k: v for k, v in p.items() if k != "maxDepth"}
        groups.setdefault(str(rest if whole else p), []).append(p)
    return [sorted(g, key=lambda p: p.get("maxDepth", 5)) for g in groups.values()]


def in_parallel(jobs: Sequence[Callable[[], object]], spark, threads: int = 8) -> list:
    """Run fits side by side, begun in order; each thread keeps the session's job settings."""
    if len(jobs) <= 1:
        return [j() for j in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda j: inheritable_thread_target(spark)(j)(), jobs, chunksize=1)


def cross_validate(
    candidate: Candidate, rows: DataFrame, features: list[str], folds: Sequence[Fold], params_list: Sequence[dict],
    whole: dict[str, PipelineModel] | None = None,
) -> list[tuple]:
    """One result per parameter set and fold; training rows always precede the test rows.

    ``whole``, if given, is filled with the models of all rows that cost no pass of their own.
    """
    if candidate.together:
        return _cross_validate_together(candidate, rows, features, folds, params_list, whole)

    def job(sets: list[dict], f: Fold):
        def run():
            model = fit(candidate, rows.where(f.train()), features, sets[-1])
            test = rows.where(f.test())
            scores = score_depths(model, test, features, [p.get("maxDepth", 5) for p in sets[:-1]]) if sets[1:] else [score(model, test)]
            return [(candidate.name, str(p), f.fold, m["r2"], m["rmse"], m["mae"]) for p, m in zip(sets, scores)]
        return run

    jobs = [(sets, f) for sets in shared_fits(candidate, features, params_list) for f in folds]
    jobs.sort(key=lambda j: -j[1].train_end)  # the largest first, so none is left to run alone
    found = {row[1:3]: row for done in in_parallel([job(*j) for j in jobs], rows.sparkSession) for row in done}
    return [found[str(p), f.fold] for p in params_list for f in folds]


WHOLE_SETS = 2  # with more sets, fits of all rows are dearer side by side than that of the best set later


def _cross_validate_together(candidate, rows, features, folds, params_list, whole) -> list[tuple]:
    pairs = [(p, f) for p in params_list for f in folds]
    extra = list(params_list) if pairs and whole is not None and len(params_list) <= WHOLE_SETS else []
    sets = [*((p, f.train_end) for p, f in pairs), *((p, None) for p in extra)]
    models = candidate.together(rows, features, sets) if sets else []
    if extra:
        whole.update(zip(map(str, extra), models[len(pairs):]))
    jobs = [lambda model=model, f=f: score(model, rows.where(f.test())) for (_, f), model in zip(pairs, models)]
    return [(candidate.name, str(p), f.fold, m["r2"], m["rmse"], m["mae"])
            for (p, f), m in zip(pairs, in_parallel(jobs, rows.sparkSession))]


@contextmanager
def kept(df: DataFrame):
    """Hold a feature table in memory and on disk while models are fitted on it."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Trained:
    """Fold scores, holdout results and fitted models of one training run."""

    fold_rows: list[tuple]
    results: list[tuple]
    models: dict[str, PipelineModel]
    skipped: list[tuple[str, str, str]]

    FOLD_SCHEMA = "model string, params string, fold int, r2 double, rmse double, mae double"
    RESULT_SCHEMA = (
        "model string, best_params string, cv_mean_r2 double, cv_std_r2 double, r2 double, rmse double, "
        "mae double, residual_mean double, residual_max_abs double, mape double, target_std double, "
        "fit_time_sec double, status string, reason string"
    )

    def folds(self, spark) -> DataFrame:
        return spark.createDataFrame(self.fold_rows, self.FOLD_SCHEMA)

    def table(self, spark) -> DataFrame:
        blank = (None,) * 11
        failed = [(name, *blank, status, reason) for name, status, reason in self.skipped]
        return spark.createDataFrame([*self.results, *failed], self.RESULT_SCHEMA)


def train_candidates(
    train: DataFrame, holdout: DataFrame, features: list[str], names: Sequence[str],
    folds: Sequence[Fold], search: bool = True,
) -> Trained:
    """Search, refit and score each named candidate; failures are recorded and passed over."""
    out = Trained([], [], {}, [])
    used = ["t_idx", "y", *features]
    with kept(train.select(*used)) as train, kept(holdout.select(*used)) as holdout:
        for name in names:
            if name not in CANDIDATES:
                out.skipped.append((name, "skipped", UNAVAILABLE.get(name, "unknown family")))
                continue
            candidate = CANDIDATES[name]
            sets = parameter_sets(candidate.grid)
            start = time.time()
            try:
                whole: dict[str, PipelineModel] = {}
                rows = cross_validate(candidate, train, features, folds, sets if search else sets[:1], whole)
                means: dict[str, list[float]] = {}
                for r in rows:
                    means.setdefault(r[1], []).append(r[3])
                best = max(means, key=lambda p: float(np.mean(means[p]))) if means else str(sets[0])
                model = whole.get(best) or fit(candidate, train, features, next(p for p in sets if str(p) == best))
                m = score(model, holdout)
            except Exception as e:  # noqa: BLE001 - one bad candidate must not end the run
                out.skipped.append((name, "failed", f"{type(e).__name__}: {str(e)[:200]}"))
                continue
            cv = means.get(best, [])
            spread = float(np.std(cv, ddof=1)) if len(cv) > 1 else None
            out.fold_rows += rows
            out.models[name] = model
            out.results.append((
                name, best, float(np.mean(cv)) if cv else None, spread, m["r2"], m["rmse"], m["mae"],
                m["residual_mean"], m["residual_max_abs"], m["mape"], m["target_std"],
                time.time() - start, "ok", None,
            ))
    return out


# Families on the menu, with the profile they suit and the reason given.
def _menu() -> list[tuple[str, object, object]]:
    always, wide, seasonal = F.lit(True), F.col("features") > 20, F.col("seasonality_detected")
    boost = F.when(F.col("autocorrelated"), "non-linear interactions").otherwise("tabular default")
    return [
        ("ridge", always, F.lit("cheap linear baseline")),
        ("lasso", wide, F.lit("many features")),
        ("extra_trees", wide, F.lit("high-dimensional feature space")),
        ("holt_winters", seasonal, F.lit("confirmed seasonality")),
        ("sarima", seasonal, F.lit("confirmed seasonality")),
        ("gradient_boosting", always, boost),
        ("rbf_kernel", always, F.when(F.col("rows") < 50_000, "medium dataset, smooth target").otherwise(
            "large dataset: linear in rows here, kernel methods elsewhere are not")),
        ("random_forest", always, F.lit("general purpose")),
    ]


def menu_rows(profiles: DataFrame) -> DataFrame:
    """Families to try for each profile row, at least three, each with a reason.

    Reads ``rows``, ``features``, ``seasonality_detected`` and ``autocorrelated``.
    """
    entries = F.array(*[
        F.when(F.coalesce(suits, F.lit(False)), F.struct(F.lit(name).alias("family"), why.alias("reason")))
        for name, suits, why in _menu()
    ])
    return profiles.select("*", F.inline(F.array_compact(entries)))


def save_models(models: dict[str, PipelineModel], folder: str, best: str) -> dict[str, str]:
    """Write every candidate and the best one; each loads in a fresh session."""
    paths = {}
    for name, model in models.items():
        paths[name] = f"{folder}/candidate-{name}"
        model.write().overwrite().save(paths[name])
    paths["best"] = f"{folder}/model"
    models[best].write().overwrite().save(paths["best"])
    return paths


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


@dataclass(frozen=True)
class LogTarget:
    """Fit on log1p of a skewed target, score on its own scale."""

    candidate: Candidate

    def fit(self, train: DataFrame, features: list[str], params: dict) -> PipelineModel:
        return fit(self.candidate, train.withColumn("y", F.log1p("y")), features, params)

    def predict(self, model: PipelineModel, rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("prediction", F.expm1("prediction"))
