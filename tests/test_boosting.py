"""Boosted trees of many training sets, grown by the same passes."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidecast.operators import boosting, training


def rows_of(spark, n, parts=1):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=n), np.where(rng.random(n) < 0.4, 0.0, rng.gamma(2.0, size=n))
    y = np.sin(2 * a) + b * (a > 0) + 0.1 * rng.normal(size=n)
    values = [(i, float(u), float(v), float(w)) for i, (u, v, w) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(spark.sparkContext.parallelize(values, parts), "t_idx int, a double, b double, y double").cache()


def alone(rows, params):
    columns = VectorAssembler(inputCols=["a", "b"], outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol="y", seed=training.SEED, **params).fit(columns.transform(rows))
    return model, lambda df: columns.transform(df)


def apart(ours, model, columns, rows):
    both = columns(ours.transform(rows).withColumnRenamed("prediction", "ours").drop("_x"))
    return model.transform(both).agg(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0]


def test_all_sets_and_folds_share_their_passes_and_equal_single_fits(spark):
    rows, sc = rows_of(spark, 400), spark.sparkContext
    folds = [training.Fold(0, 150, 200, 250), training.Fold(1, 300, 320, 400)]
    sets = [{"maxDepth": 2, "maxIter": 4, "stepSize": 0.2}, {"maxDepth": 3, "maxIter": 4, "stepSize": 0.1}]
    candidate, whole = training.CANDIDATES["gradient_boosting"], {}
    sc.setJobGroup("together", "boosted fits")
    found = training.cross_validate(candidate, rows, ["a", "b"], folds, sets, whole)
    jobs = len(sc.statusTracker().getJobIdsForGroup("together"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60  # a pass a level for all six fits, not for each
    p, f = sets[1], folds[0]
    model, columns = alone(rows.where(f.train()), p)
    expected = training.score(training.PipelineModel([VectorAssembler(inputCols=["a", "b"], outputCol="_x"), model]), rows.where(f.test()))
    got = next(r for r in found if r[1:3] == (str(p), f.fold))
    assert np.allclose(got[3:], [expected[k] for k in ("r2", "rmse", "mae")], rtol=1e-9)
    model, columns = alone(rows, p)
    ours = whole[str(p)]
    assert apart(ours, model, columns, rows) < 1e-9
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), model.featureImportances.toArray())
    assert ours.stages[-1].totalNumNodes == model.totalNumNodes


def test_cuts_of_many_rows_are_those_of_a_drawn_sample(spark):
    rows = rows_of(spark, 15_000, 3)
    params = {"maxDepth": 2, "maxIter": 2, "maxBins": 8}
    model, columns = alone(rows, params)
    assert apart(training.fit(training.CANDIDATES["gradient_boosting"], rows, ["a", "b"], params), model, columns, rows) < 1e-9


def test_cuts():
    assert boosting.thresholds(np.array([1.0, 3.0, 0.0, 3.0]), 4, 32).tolist() == [0.5, 2.0]
    assert boosting.thresholds(np.arange(1.0, 9.0), 8, 4).tolist() == [2.5, 4.5, 6.5]
    assert boosting.thresholds(np.full(5, 2.0), 5, 32).tolist() == []


def test_targets_and_columns_without_a_number_are_refused(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 2.0), (2, 3.0, 3.0)], "t_idx int, a double, y double")
    for bad in (rows, rows.fillna(0.0).withColumn("y", F.when(F.col("t_idx") == 1, float("inf")).otherwise(F.col("y")))):
        with pytest.raises(Exception, match="null, NaN or infinite"):
            training.fit(training.CANDIDATES["gradient_boosting"], bad, ["a"], {})


def test_target_that_does_not_vary(spark):
    rows = spark.createDataFrame([(float(i), 2.0) for i in range(30)], "a double, y double")
    model = training.fit(training.CANDIDATES["gradient_boosting"], rows, ["a"], {"maxIter": 2})
    assert model.transform(rows).where("prediction = 2").count() == 30
