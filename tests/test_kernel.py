"""The kernel candidate's waves."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression

from tidecast.operators import huber, training


def test_waves_follow_their_formula_and_survive_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2)) * [1.0, 5.0] + [2.0, -1.0]
    rows = spark.createDataFrame([(float(a), float(b), float(a - b)) for a, b in x], "a double, b double, y double")
    model = training.fit(training.CANDIDATES["rbf_kernel"], rows, ["a", "b"], {"components": 4, "width": 2.0})
    draw = np.random.default_rng(training.SEED)
    weights, shifts = draw.normal(scale=1 / (2.0 * np.sqrt(2)), size=(4, 2)), draw.uniform(0, 2 * np.pi, size=4)
    expected = np.cos((x - x.mean(0)) / x.std(0, ddof=1) @ weights.T + shifts)
    loaded = training.load_model(training.save_models({"k": model}, str(tmp_path), "k")["best"])
    for m in (model, loaded):
        got = {(r["a"], r["b"]): r["_waves"].toArray() for r in m.transform(rows).collect()}
        assert all(np.allclose(got[tuple(v)], e) for v, e in zip(x.tolist(), expected))


def test_waves_refuse_missing_values(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0)], "a double, y double")
    with pytest.raises(Exception, match="null, NaN or infinite"):
        training.fit(training.CANDIDATES["rbf_kernel"], rows, ["a"], {})


def test_results_keep_the_order_of_sets_and_folds(spark, monkeypatch):
    begun = []

    def fit(candidate, train, features, params):
        begun.append(params["p"])
        return None

    monkeypatch.setattr(training, "fit", fit)
    monkeypatch.setattr(training, "score", lambda m, rows: {"r2": None, "rmse": None, "mae": None})
    folds = [training.Fold(i, 2 + i, 3 + i, 4 + i) for i in range(3)]
    rows = training.cross_validate(training.CANDIDATES["ridge"], spark.range(9).withColumnRenamed("id", "t_idx"),
                                   [], folds, [{"p": 1}, {"p": 2}])
    assert [(r[1], r[2]) for r in rows] == [(str({"p": p}), i) for p in (1, 2) for i in range(3)]
    assert sorted(begun) == [1, 1, 1, 2, 2, 2]


def test_all_sets_and_folds_share_their_passes_and_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [1.0, 4.0] + [0.5, 20.0]
    y = x @ [1.0, 0.3] + np.where(rng.random(400) < 0.1, 30.0, 1.0) * rng.normal(size=400)
    rows = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "t_idx int, a double, b double, y double").repartition(3).cache()
    candidate, sc = training.CANDIDATES["rbf_kernel"], spark.sparkContext
    folds = [training.Fold(0, 150, 200, 250), training.Fold(1, 300, 320, 400)]
    sets, whole = training.parameter_sets(candidate.grid), {}
    sc.setJobGroup("together", "kernel fits")
    found = training.cross_validate(candidate, rows, ["a", "b"], folds, sets, whole)
    jobs = len(sc.statusTracker().getJobIdsForGroup("together"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150  # six fits of up to 50 steps each, which share their passes
    for (_, params, fold, r2, rmse, mae), (p, f) in list(zip(found, [(p, f) for p in sets for f in folds]))[1:3]:
        assert (params, fold) == (str(p), f.fold)
        model = training.fit(candidate, rows.where(f.train()), ["a", "b"], p)
        columns = model.stages[1].transform(model.stages[0].transform(rows.where(f.train())))
        alone = LinearRegression(featuresCol="_x", labelCol="y", loss="huber", regParam=0.01, maxIter=50).fit(columns)
        assert np.allclose(model.stages[2].coefficients.toArray(), alone.coefficients.toArray(), rtol=1e-4, atol=1e-5)
        assert np.allclose([model.stages[2].intercept, model.stages[2].scale], [alone.intercept, alone.scale], rtol=1e-4, atol=1e-5)
        m = training.score(model, rows.where(f.test()))
        assert np.allclose([r2, rmse, mae], [m["r2"], m["rmse"], m["mae"]], rtol=1e-6)
    assert len(found) == 4 and set(whole) == {str(p) for p in sets}


def test_kernel_of_a_target_that_does_not_vary(spark):
    rows = spark.createDataFrame([(float(i), 2.0) for i in range(30)], "a double, y double")
    model = training.fit(training.CANDIDATES["rbf_kernel"], rows, ["a"], {})
    assert model.transform(rows).where("abs(prediction - 2) < 1e-9").count() == 30


def test_search_stops_at_its_bounds():
    target = np.array([3.0, -2.0])
    found = huber.side_by_side([huber.minimised(np.array([1.0, 1.0]), np.array([-np.inf, 0.5])) for _ in range(2)],
                               lambda asked: {i: (float(((p - target) ** 2 * [1, 5]).sum()), 2 * (p - target) * [1, 5]) for i, p in asked.items()})
    assert all(np.allclose(point, [3.0, 0.5], atol=1e-4) for point, _ in found)
