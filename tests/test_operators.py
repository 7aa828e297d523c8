"""Hand-computed cases and the edge cases a run has to survive."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import tails
from tidecast.functions.names import normalised_names
from tidecast.functions.stats import correlations
from tidecast.operators import (
    benchmarks, cleanse, evaluation, features as fx, inference, information, leakage, metrics, profile, screening,
    selection, smoothing, split, stattests, training,
)
from tidecast.plans import forecast
from tidecast.sources import files

RNG = random.Random(42)
NOISE = [RNG.gauss(0, 1) for _ in range(2000)]


def ar1(phi, n=2000):
    out = [0.0]
    for e in NOISE[: n - 1]:
        out.append(phi * out[-1] + e)
    return out


def test_names():
    assert normalised_names([" A  b ", "a_b", "A__B", "_c_"]) == ["a_b", "a_b_2", "a_b_3", "c"]


def test_tails_known_values():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.dickey_fuller_p(-2.86) == pytest.approx(0.05, abs=0.002)
    assert tails.dickey_fuller_p(-3.43) == pytest.approx(0.01, abs=0.001)


def test_correlations_with_nulls_and_constants(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(1e6, 1, 500), rng.normal(0, 1, 500)
    c = a + b
    rows = [(float(x), None if i % 7 == 0 else float(y), float(z), 3.0) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = correlations(df, [("a", "b"), ("a", "c"), ("b", "c"), ("a", "k")])
    keep = np.arange(500) % 7 != 0
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1], abs=1e-7)
    assert got[("a", "c")] == pytest.approx(np.corrcoef(a, c)[0, 1], abs=1e-7)
    assert got[("b", "c")] == pytest.approx(np.corrcoef(b[keep], c[keep])[0, 1], abs=1e-7)
    assert got[("a", "k")] is None


def test_wide_correlation_agrees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 20))
    df = spark.createDataFrame([[float(v) for v in r] for r in x], ", ".join(f"c{i} double" for i in range(20)))
    got = {(r[0], r[1]): r[2] for r in profile.correlation_pairs(df, df.columns).collect()}
    assert got[("c3", "c11")] == pytest.approx(np.corrcoef(x[:, 3], x[:, 11])[0, 1], abs=1e-9)


def test_malformed_csv_keeps_every_line(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n3,4,5\nx,6\n7\n")
    from pyspark.sql import types as T
    scan = files.scan_csv(spark, str(path), T.StructType.fromDDL("a int, b int"))
    assert {r["raw_line"] for r in files.malformed_rows(scan).collect()} == {"3,4,5", "x,6", "7"}
    with pytest.raises(Exception):
        files.scan_csv(spark, str(tmp_path / "missing.csv"))


def test_tree_attributions_equal_all_subsets(spark):
    from itertools import combinations

    from tidecast.operators import trees

    rnd = random.Random(5)
    x = [[rnd.random() for _ in range(4)] for _ in range(400)]
    rows = [(i, *v, 3 * v[0] + (v[1] > 0.5) * v[2] - v[3] * v[0]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "t_idx long, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    for family, params in (("random_forest", {"maxDepth": 5, "numTrees": 4}), ("gradient_boosting", {"maxDepth": 3, "maxIter": 3, "stepSize": 0.3})):
        model = training.fit(training.CANDIDATES[family], df, names, params)
        found = trees.leaves(model)

        def worth(row, subset):
            return sum(leaf.value * math.prod(
                float(lo < row[f] <= hi) if f in subset else z for f, lo, hi, z in zip(leaf.features, leaf.low, leaf.high, leaf.share)) for leaf in found)
        got = {}
        for r in trees.tree_attributions(model, df.where("t_idx < 12"), names).collect():
            got.setdefault(r["row_id"], {})[r["feature"]] = r["shap"]
        predicted = {r["t_idx"]: r["prediction"] for r in model.transform(df.where("t_idx < 12")).collect()}
        for i, row in enumerate(x[:12]):
            for j, name in enumerate(names):
                others = [k for k in range(4) if k != j]
                exact = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (worth(row, {*s, j}) - worth(row, s))
                            for n in range(4) for s in map(set, combinations(others, n)))
                assert got[i][name] == pytest.approx(exact, abs=1e-9)
            assert sum(got[i].values()) == pytest.approx(predicted[i] - trees.base_value(found), abs=1e-9)
    missing = trees.tree_attributions(model, df.where("t_idx < 3").withColumn("a", F.lit(None).cast("double")), names).collect()
    assert len(missing) == 12 and all(math.isfinite(r["shap"]) for r in missing)


def test_panel_ridge_against_single_series(spark):
    from tidecast.operators import panel

    rnd = random.Random(6)
    rows = [(k, i, rnd.random(), rnd.random()) for k in ("a", "b", None) for i in range(200)]
    rows = [(k, i, u, v, 1000.0 + (2 * u - v if k == "a" else v) + 0.1 * rnd.random()) for k, i, u, v in rows] + [("tiny", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, t_idx long, u double, v double, y double")
    found = {r["id"]: r for r in panel.panel_ridge(df, ["u", "v"], ["id"]).collect()}
    assert found.keys() == {"a", "b", None} and found["a"]["penalty"] == 0.0 and found["a"]["r2"] > 0.95
    assert found["a"]["coefficients"] == pytest.approx([2, -1], abs=0.1) and found["b"]["coefficients"][0] == pytest.approx(0, abs=0.1)
    mine = np.array([r[2:] for r in rows if r[0] == "a" and r[1] < 160])
    fit = np.linalg.lstsq(np.column_stack([np.ones(160), mine[:, :2]]), mine[:, 2], rcond=None)[0]
    assert [found["a"]["intercept"], *found["a"]["coefficients"]] == pytest.approx(fit.tolist(), abs=1e-6)
    models = panel.panel_ridge(df, ["u", "v"], ["id"])
    scored = panel.panel_predictions(df.where("id = 'a' and t_idx >= 160"), models, ["u", "v"], ["id"])
    assert metrics.evaluate(scored, ()).first()["r2"] == pytest.approx(found["a"]["r2"], abs=1e-6)


def test_forecast_with_known_sources(spark):
    from tidecast.operators import features as fx, inference

    rows = [("a", i, 1.0 * i, float(i % 3)) for i in range(10)] + [("b", i, 5.0, 2.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id string, t_idx long, y double, x double").selectExpr(
        "id", "t_idx", "y", "x", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(t_idx as int) * 60) as t")
    plan = [*fx.lag_features("y", [1]), *fx.lag_features("x", [1], "x", "source")]
    model = inference.FixedLinear(("y_lag_1", "x_lag_1"), (0.5, 1.0), 0.0)
    ahead = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, None)], "id string, step int, x double")
    got = {(r["id"], r["step"]): r["forecasted_value"] for r in inference.forecast_recursive(
        model, df, plan, 5, 60, ["id"], ["x"], ahead).collect()}
    want, y, x = {}, 9.0, 0.0
    for step, known in enumerate([10.0, 20.0, 20.0, 20.0, 20.0], 1):
        y = 0.5 * y + x
        want["a", step], x = y, known
    y = 5.0
    for step in range(1, 6):
        y = want["b", step] = 0.5 * y + 2.0
    assert got == pytest.approx(want)


def test_targets_without_values_and_holed_columns(spark):
    from tidecast.operators import cleanse, features as fx

    df = spark.createDataFrame([("a", i, float("nan") if i % 4 == 0 else None if i % 4 == 1 else float(i)) for i in range(40)] + [("b", 0, None)],
                               "id string, t_idx long, y double")
    empty = fx.target_distribution(df.where("id = 'b'"), "y").first()
    assert empty["mean"] is None and empty["outlier_fraction"] is None and empty["tree_model_suitable"] == "not suitable"
    known = [float(i) for i in range(40) if i % 4 > 1]
    assert fx.target_distribution(df, "y").first()["mean"] == pytest.approx(np.mean(known))
    report = cleanse.outlier_report(df, ["y"]).first()
    assert (report["outliers"], report["values"]) == (0, 20)
    filled = cleanse.fill_nulls(df, "y", "mean", series_cols=["id"], fitted_on=F.col("t_idx") < 20).collect()
    assert {r["y"] for r in filled if r["id"] == "a" and r["t_idx"] % 4 < 2} == {np.mean([v for v in known if v < 20])}
    assert [r["y"] for r in filled if r["id"] == "b"] == [None]
    assert cleanse.fill_nulls(df, "y", "drop").count() == 20


def test_runs_show_up_whole_or_not_at_all(spark, tmp_path):
    from tidecast.operators import runs

    folder = str(tmp_path)
    assert runs.stored_runs(spark, folder).count() == 0
    run = runs.StoredRun(spark, folder, "one")
    kept = run.keep(spark.range(10).withColumn("y", F.when(F.col("id") > 2, F.col("id"))), "known", F.col("y") > 4, "small or unknown")
    assert run.store("rows", kept).count() == 5
    with pytest.raises(ValueError, match="already"):
        run.store("rows", kept)
    with pytest.raises(ValueError, match="no finished run"):
        runs.load_table(spark, folder, "one", "rows")
    run.finish(model=None, r2=0.5)
    assert runs.load_table(spark, folder, "one", "rows").count() == 5
    assert [tuple(r) for r in runs.load_table(spark, folder, "one", "row_log").collect()] == [("known", "small or unknown", 10, 5)]


def test_feature_cache_tells_inputs_and_plans_apart(spark, series, tmp_path):
    from tidecast.operators import cache, features as fx

    df, folder = series([1.0, 2.0, 3.0, 4.0]), str(tmp_path)
    lags = [cache.cached_features(df, fx.lag_features("y", k), folder=folder) for k in ([1], [1], [2])]
    assert [c.rows_read for c in lags] == [4, 0, 4] and lags[1].table.columns == lags[0].table.columns
    other = series([1.0, 2.0, 3.0, 5.0])
    assert cache.cached_features(other, fx.lag_features("y", [1]), folder=folder).rows_read == 4
    assert cache.content_hash(df) == cache.content_hash(df.repartition(3)) != cache.content_hash(other)


def test_relaxed_screening_brings_back_what_the_baseline_kept_out(spark):
    from tidecast.operators import screening

    first = screening.Screening(["a"], [("b", "below_noise_baseline", 4), ("c", "below_noise_baseline", 4), ("copy", "below_noise_baseline", 4),
                                        ("flat", "low_variance", 1)], {"a": 0.5, "b": 0.08, "c": 0.02, "copy": 0.07, "flat": 0.3}, 0.1, False, [])
    df = spark.range(50).selectExpr("sin(id) as a", "cos(id * id) as b", "id * 1.0D as c", "2 * sin(id) as copy", "1.0D as flat")
    again = screening.relaxed_screening(df, first)
    assert again.recommended == ["a", "b"] and again.loosened
    assert dict((f, r) for f, r, _ in again.excluded) == {"c": "below_noise_baseline", "copy": "redundant", "flat": "low_variance"}


def test_smoothing_in_chunks_equals_a_loop(series):
    from tidecast.operators.smoothing import Scan, Smoothing, smooth

    wave = [math.sin(2 * math.pi * i / 12) + 0.01 * i + NOISE[i % len(NOISE)] for i in range(5000)]
    for period in (0, 1, 2, 7, 12, 64, 65, 1008):
        options = [Smoothing(a, 0.1, 0.2 if period else 0.0, period) for a in (0.1, 0.9)]
        values = wave[:2200] if period > 100 else wave
        scan, y = Scan(options), np.array(values)
        start = np.stack([o.opening(y) for o in options])
        got, end = scan.run(y, start)
        for p, o in enumerate(options):
            step, gain, ahead = o.matrices()
            state, want = start[p], []
            for v in values:
                want.append(ahead @ state)
                state = step @ state + gain * v
            assert np.allclose(got[:, p], want, atol=1e-8) and np.allclose(end[p], state, atol=1e-8)
        zeros = scan.run(np.zeros(777), start)[1]
        assert np.allclose(scan.over(777)(start), zeros, atol=1e-8)
        half = scan.run(y[2000:], scan.run(y[:2000], start)[1])
        assert np.allclose(half[0], got[2000:], atol=1e-8)
    long = Smoothing(0.2, 0.1, 0.3, 1008)
    found = [[r["prediction"] for r in smooth(series(wave), [long], stretch=size).orderBy("t_idx").collect()] for size in (500, 4096)]
    assert np.allclose(*found, atol=1e-8)


def test_periods_nobody_named(spark):
    from tidecast.operators import periods

    rnd = random.Random(11)
    noise = [rnd.gauss(0, 1) for _ in range(3000)]
    shapes = {"saw": lambda i: i % 23, "wave": lambda i: 5 * math.sin(2 * math.pi * i / 12), "noise": lambda i: 0.0,
              "flat": lambda i: None, None: lambda i: 4 * math.sin(2 * math.pi * i / 50) + 0.01 * i, "short": lambda i: 9 * (i % 5 == 0)}
    rows = [(k, i, None if (i + len(k or "")) % 17 == 3 or k == "flat" else float(f(i) + noise[(i * 7 + len(k or "")) % 3000]))
            for k, f in shapes.items() for i in range(60 if k == "short" else 2500)]
    df = spark.createDataFrame(rows, "id string, t_idx long, y double")
    found = {}
    for r in periods.find_periods(df, "y", ["id"], segment=512).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["period"]))
    first = {k: min(v)[1] for k, v in found.items()}
    assert abs(first.pop(None) - 50) <= 1  # noise may move the flat top of a long smooth wave by a row
    assert first == {"saw": 23, "wave": 12, "short": 5}
    assert all(len(v) == 1 for k, v in found.items() if k != "short")
    curve = {r["lag"]: r["acf"] for r in periods.long_acf(df.where("id = 'saw'").drop("id"), "y", segment=512).collect()}
    assert curve[23] > 0.8 and len(curve) == 256
    assert periods.find_periods(df.where("t_idx < 0"), "y").count() == 0


def test_csv_files_with_their_own_headers(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "in a[1]").mkdir()
    (tmp_path / "in a[1]" / "one 1.csv").write_text("\ufeffa,b,,A\n1,2,3,4\n5\n")
    (tmp_path / "in a[1]" / "two.csv").write_text('b,"a",c\n6,7,8\n9,10,11,12\n')
    (tmp_path / "in a[1]" / "none.csv").write_text("")
    (tmp_path / "in a[1]" / "three.csv").write_text("c,a\n")
    scan = files.scan_csv(spark, str(tmp_path / "in a\\[1\\]"))
    got = {(r["a"], r["b"], r["_c2"], r["A_2"], r["c"], r[files.CORRUPT]) for r in scan.collect()}
    assert got == {("1", "2", "3", "4", None, None), ("5", None, None, None, None, "5"), ("7", "6", None, None, "8", None),
                   ("10", "9", None, None, "11", "9,10,11,12")}
    typed = files.scan_csv(spark, str(tmp_path / "in a\\[1\\]" / "two.csv"), T.StructType.fromDDL("a int"))
    assert [(r["a"], r["b"]) for r in typed.collect()] == [(7, "6"), (10, "9")]
    with pytest.raises(ValueError, match="hinted"):
        files.scan_csv(spark, str(tmp_path / "in a\\[1\\]" / "two.csv"), T.StructType.fromDDL("z int"))
    assert files.scan_csv(spark, str(tmp_path / "in a\\[1\\]" / "none.csv")).count() == 0


def test_header_is_read_without_the_rest(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" + "1,2\n" * 400_000)
    assert [tuple(r)[1] for r in files.header_lines(spark, [str(path)]).collect()] == ["a,b"]


def test_mixed_types_are_cast_leniently(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-01 00:00:00"), ("x", None, "2024-01-02 00:00:00")], "a string, b string, c string")
    typed, report = cleanse.infer_types(df, {"a": "bigint"})
    found = {r["column"]: (r["inferred_type"], r["invalid_casts"]) for r in report.collect()}
    assert found == {"a": ("bigint", 1), "b": ("double", 0), "c": ("timestamp_ntz", 0)}
    assert [r["a"] for r in typed.collect()] == [1, None]


def test_target_must_exist_and_hold_values(spark):
    df = spark.createDataFrame([(None, "a")], "y double, s string")
    for target in ("nope", "s", "y"):
        with pytest.raises(ValueError):
            cleanse.validate_target(df, target)


def test_noise_edges_close_to_sample_edges(series):
    df = series(NOISE)
    noisy, names = information.with_noise(df, F.col("t_idx"))
    known = information.mutual_information(noisy, names, "y", known_edges=information.noise_edges(names))
    sample = information.mutual_information(noisy, names, "y")
    a = np.mean([r["mi"] for r in known.collect()])
    b = np.mean([r["mi"] for r in sample.collect()])
    assert a == pytest.approx(b, rel=0.15)
    stats = noisy.agg(F.avg("noise_0"), F.stddev("noise_0"), F.corr("noise_0", "noise_1")).first()
    assert abs(stats[0]) < 0.1 and abs(stats[1] - 1) < 0.1 and abs(stats[2]) < 0.1


def test_all_noise_loosens_and_keeps_something():
    kept, threshold, loosened = screening.above_noise([("a", 0.3), ("b", 0.1)], 0.5)
    assert (kept, threshold, loosened) == (["a"], 0.25, True)
    kept, _, loosened = screening.above_noise([("a", 0.01), ("b", 0.02)], 0.5)
    assert kept == ["b"] and loosened
    assert screening.above_noise([("a", 0.6), ("b", 0.1)], 0.5) == (["a"], 0.5, False)


def test_twin_and_copied_target_are_excluded(series):
    x = [RNG.random() for _ in NOISE]
    y = [3 * a + 0.3 * e for a, e in zip(x, NOISE)]
    df = series(y, x=x, twin=[2 * a for a in x], copy=[2 * v for v in y], flat=[1.0] * len(x))
    found = screening.screen_features(df, "y", F.col("t_idx"), ["x", "twin", "copy", "flat"])
    reasons = {f: r for f, r, _ in found.excluded}
    assert reasons["copy"] == "leakage_suspect" and reasons["flat"] == "low_variance"
    assert len(found.recommended) == 1 and sorted(reasons.values()).count("redundant") == 1


def test_adf_tells_ar_from_walk(series):
    steady = stattests.adf(series(ar1(0.7)), "y").first()
    walk = stattests.adf(series(ar1(1.0)), "y").first()
    assert steady["stationary"] and steady["adf_stat"] < -10
    assert not walk["stationary"] and walk["p_value"] > 0.05


def test_adf_equals_plain_least_squares(series):
    y = np.array(ar1(0.9, 300))
    row = stattests.adf(series(y), "y", max_lag=2).first()
    d, p = np.diff(y), row["used_lag"]
    at = np.arange(3, len(y))
    cols = [np.ones(len(at)), y[at - 1], *[d[at - 1 - k] for k in range(1, p + 1)]]
    x = np.column_stack(cols)
    target = d[at - 1]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    rest = target - x @ beta
    cov = rest @ rest / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)
    assert row["adf_stat"] == pytest.approx(beta[1] / math.sqrt(cov[1, 1]), rel=1e-6)


def test_adf_sums_join_over_stretches_and_series(spark, monkeypatch):
    def no_columns(*args, **kwargs):
        raise AssertionError("a column for each lag")

    monkeypatch.setattr(stattests, "over_order", no_columns)
    monkeypatch.setattr(stattests, "STRETCH", 60)
    walk = np.cumsum(np.array(ar1(0.6, 700)))
    lengths = {"a": 700, "b": 333, None: 61, "c": 7, "d": 4}
    rows = [(k, i, float(walk[i] + 100 * np.sin(i))) for k, n in lengths.items() for i in range(n)]
    found = stattests.adf(spark.createDataFrame(rows, "k string, t_idx bigint, y double"), "y", max_lag=5, series_cols=["k"])
    found = {r["k"]: r for r in found.collect()}
    assert set(found) == {"a", "b", None, "c"}
    assert found["c"]["adf_stat"] is None and found["c"]["n_obs"] == 1
    for k in ("a", "b", None):
        y = walk[: lengths[k]] + 100 * np.sin(np.arange(lengths[k]))
        d, at, best = np.diff(y), np.arange(6, len(y)), None
        for p in range(6):
            x = np.column_stack([np.ones(len(at)), y[at - 1], *[d[at - 1 - j] for j in range(1, p + 1)]])
            beta, *_ = np.linalg.lstsq(x, d[at - 1], rcond=None)
            rest = d[at - 1] - x @ beta
            score = len(at) * math.log(rest @ rest / len(at)) + 2 * (p + 2)
            if best is None or score < best[0]:
                cov = rest @ rest / (len(at) - p - 2) * np.linalg.inv(x.T @ x)
                best = score, beta[1] / math.sqrt(cov[1, 1]), p
        assert found[k]["n_obs"] == len(at) and found[k]["used_lag"] == best[2]
        assert found[k]["adf_stat"] == pytest.approx(best[1], rel=1e-6)


def test_noise_and_walk_flags(series):
    noise = forecast.noise_flags(series(NOISE), "y").first()
    walk = forecast.noise_flags(series(ar1(1.0)), "y").first()
    assert noise["white_noise"] and not noise["random_walk"]
    assert walk["random_walk"] and not walk["white_noise"]


def test_short_series_gets_nulls_not_errors(series):
    row = stattests.adf(series(NOISE[:20]), "y").first()
    assert row["adf_stat"] is None and row["stationary"] is None
    facts = forecast.series_profile(series(NOISE[:20]))
    assert facts["stationary"] is None and facts["warnings"]


def test_acf_and_pacf_of_ar1(series):
    curve = {r["lag"]: (r["acf"], r["pacf"]) for r in stattests.pacf(stattests.acf(series(ar1(0.7)), "y", 5)).collect()}
    y = np.array(ar1(0.7)) - np.mean(ar1(0.7))
    assert curve[2][0] == pytest.approx((y[2:] @ y[:-2]) / (y @ y), abs=1e-10)
    assert curve[1][0] == pytest.approx(curve[1][1]) and abs(curve[3][1]) < 0.1


def test_causality_audit_finds_the_present(series):
    df = series(NOISE[:300])

    def plan(col):
        return [
            *fx.lag_features(col, [1]),
            fx.Feature("leak", lambda w: F.avg(col).over(w.rowsBetween(-2, 0)), 1, 2, ("target", "rolling")),
        ]

    changed = {r["feature"]: r["changed"] for r in leakage.causality_audit(df, plan).collect()}
    assert changed["y_lag_1"] == 0 and changed["leak"] > 0
    with pytest.raises(ValueError):
        fx.lag_features("y", [0])


def test_failed_audit_writes_no_features(spark, series, tmp_path):
    df = series(NOISE[:200])
    built, audit = leakage.leakage_audit(df, lambda c: fx.lag_features(c, [1]), extra=[], col="y")
    bad = audit.withColumn("status", F.lit("fail"))
    with pytest.raises(RuntimeError):
        leakage.write_audited(built, bad, str(tmp_path / "f"), str(tmp_path / "a"))
    assert not (tmp_path / "f").exists() and (tmp_path / "a").exists()


def test_reconstruction_probe(series):
    df = series(NOISE[:500]).withColumn("copy", F.col("y") * 2)
    assert leakage.reconstruction_probe(df, ["copy"], "y") > 0.98
    assert leakage.reconstruction_probe(df, [], "y") is None


def test_too_few_features():
    with pytest.raises(ValueError):
        fx.validate_feature_count(["only"])


def test_random_split_is_refused():
    with pytest.raises(ValueError):
        split.resolve_split_mode("random")
    with pytest.raises(ValueError):
        split.resolve_split_mode("auto", has_order=False)
    assert split.resolve_split_mode("auto") == "time_series"


def test_folds_keep_their_gap():
    folds = split.expanding_folds(703)
    width = 703 // 7
    assert len(folds) == 5 and folds[-1].test_end == 703
    assert all(f.test_start - f.train_end >= width and f.train_end >= width for f in folds)


def test_arima_recovers_ar1_and_beats_persistence(series):
    df = series(ar1(0.7))
    scored, model = benchmarks.arima(df, F.col("t_idx") < 1600)
    held = scored.where("t_idx >= 1600")
    r2 = metrics.evaluate(held, ()).first()["r2"]
    naive = metrics.evaluate(benchmarks.persistence(df).where("t_idx >= 1600"), ()).first()["r2"]
    assert r2 > naive and r2 > 0.4 and model.order[1] == 0


def test_arima_of_a_walk_with_drift(series):
    walk = [10 + 0.5 * i + v for i, v in enumerate(ar1(1.0, 800))]
    scored, model = benchmarks.arima(series(walk), F.col("t_idx") < 640, d=1)
    assert metrics.evaluate(scored.where("t_idx >= 640"), ()).first()["rmse"] < 1.3 and model.order[1] == 1


def test_seasonal_arima_learns_the_season(series):
    y = [5 * math.sin(2 * math.pi * i / 7) + 0.3 * e for i, e in enumerate(NOISE[:700])]
    scored, _ = benchmarks.arima(series(y), F.col("t_idx") < 560, period=7, seasonal_d=1)
    assert metrics.evaluate(scored.where("t_idx >= 560"), ()).first()["r2"] > 0.95


def _holt_winters(y, s):
    step, gain, ahead = s.matrices()
    state, out = s.opening(np.array(y[: 2 * max(s.period, 1)])), []
    for v in y:
        out.append(float(ahead @ state))
        state = step @ state + gain * v
    return out


@pytest.mark.parametrize("stretch", [7, 50, 4096])
def test_smoothing_is_the_same_for_any_stretch(series, stretch):
    y = [math.sin(2 * math.pi * i / 4) * 3 + 0.02 * i + 0.1 * e for i, e in enumerate(NOISE[:400])]
    option = smoothing.Smoothing(0.3, 0.1, 0.2, 4)
    got = smoothing.smooth(series(y), [option], stretch=stretch).orderBy("t_idx").collect()
    assert [r["prediction"] for r in got] == pytest.approx(_holt_winters(y, option), abs=1e-8)


def test_short_stretches_share_calls(spark):
    y = [math.sin(i) + 0.1 * e for i, e in enumerate(NOISE[:500])]
    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "k string, t_idx bigint, y double")
    out = smoothing.smooth(panel, [smoothing.Smoothing(0.3, 0.1)] * 2, series_cols=["k"], stretch=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Project \[k#\d+, call#", plan) and "offsets_of" not in plan  # states come from a written table
    want = _holt_winters(y, smoothing.Smoothing(0.3, 0.1))
    for k in ("a", None):
        got = [r["prediction"] for r in out.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("t_idx").collect()]
        assert got == pytest.approx(want, abs=1e-8)


def test_smoothing_picks_the_better_option(series):
    y = [math.sin(2 * math.pi * i / 4) * 3 + 0.05 * e for i, e in enumerate(NOISE[:200])]
    options = [smoothing.Smoothing(0.9, 0.3, 0.0, 4), smoothing.Smoothing(0.1, 0.0, 0.5, 4)]
    sse = [sum((a - b) ** 2 for a, b in zip(y, _holt_winters(y, o))) for o in options]
    got = smoothing.smooth(series(y), options).first()
    assert got["option"] == int(np.argmin(sse))


def test_mape_needs_a_target_without_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 2.0, 1.0), ("b", 4.0, 1.0)], "model string, y double, prediction double")
    got = {r["model"]: r["mape"] for r in metrics.evaluate(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(0.625)


def test_mean_predictor_has_r2_zero(spark):
    df = spark.createDataFrame([(float(i), 4.5) for i in range(10)], "y double, prediction double")
    assert metrics.evaluate(df, ()).first()["r2"] == pytest.approx(0.0)


COLUMNS = "run_id string, model string, r2 double, rmse double, mae double, cv_std_r2 double"


def test_no_viable_candidate(spark):
    df = spark.createDataFrame([("r", "ridge", -0.1, 1.0, 1.0, 0.1), ("r", "lasso", -0.2, 1.0, 1.0, 0.1)], COLUMNS)
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    got = {x["run_id"]: x for x in selection.select_best(df, runs).collect()}
    assert got["r"]["selected_model"] is None and got["r"]["quality_flag"] == "no_viable_candidate"
    assert got["empty"]["quality_flag"] == "no_viable_candidate"
    assert selection.ranking(df).count() == 2


def test_single_candidate_and_ties(spark):
    one = spark.createDataFrame([("r", "lasso", 0.6, 1.0, 1.0, 0.2)], COLUMNS)
    assert selection.ranking(one).first()["weighted_score"] == pytest.approx(0.5 + 0.25 + 0.15 + 0.08)
    tie = spark.createDataFrame([("r", m, 0.6, 1.0, 1.0, 0.2) for m in ("random_forest", "ridge", "xgboost")], COLUMNS)
    assert [x["model"] for x in selection.ranking(tie).orderBy("rank").collect()] == ["ridge", "random_forest", "xgboost"]


def test_leakage_stops_selection(spark):
    with pytest.raises(RuntimeError):
        selection.stop_on_leakage("leakage_suspected")
    df = spark.createDataFrame([("r", "ridge", 0.99, 1.0, 1.0, 0.1)], COLUMNS)
    runs = spark.createDataFrame([("r", "leakage_suspected")], "run_id string, quality_assessment string")
    got = selection.select_best(df, runs).first()
    assert got["selected_model"] is None and got["quality_flag"] == "leakage_suspected"


def _wave(series):
    df = series([3 * math.sin(2 * math.pi * i / 7) + 0.3 * e for i, e in enumerate(NOISE[:700])])
    plan = fx.lag_features("y", [1, 7])
    rows, _ = fx.drop_warm_up(fx.build(df, plan), 7)
    train, holdout = split.chronological(rows)
    return df, plan, train, holdout


def test_training_records_failures_and_goes_on(series):
    _, _, train, holdout = _wave(series)
    broken = training.Candidate("broken", lambda *_: (_ for _ in ()).throw(RuntimeError("boom")))
    training.CANDIDATES["broken"] = broken
    try:
        done = training.train_candidates(train, holdout, ["y_lag_1", "y_lag_7"], ["xgboost", "broken", "ridge"], split.expanding_folds(500)[-1:])
    finally:
        del training.CANDIDATES["broken"]
    status = {n: s for n, s, _ in done.skipped}
    assert status == {"xgboost": "skipped", "broken": "failed"} and done.results[0][0] == "ridge"
    assert done.results[0][4] > 0.9


def test_stress_test_sees_a_copied_target(series):
    _, plan, train, holdout = _wave(series)
    train, holdout = (d.withColumn("copy", F.col("y") * 2) for d in (train, holdout))
    leak = fx.Feature("copy", lambda w: F.col("y"), 0, 0, ("target",))
    _, leaked = evaluation.stress_test(train, holdout, ["y_lag_1", "copy"], [*plan, leak], best_r2=0.999)
    assert leaked
    _, leaked = evaluation.stress_test(train, holdout, ["y_lag_1"], plan, best_r2=0.9)
    assert not leaked


def test_recursive_forecast_follows_named_lags(series):
    df, plan, train, _ = _wave(series)
    model = training.fit(training.CANDIDATES["ridge"], train, ["y_lag_1", "y_lag_7"], {"regParam": 0.0})
    got = [r["forecasted_value"] for r in inference.forecast_recursive(model, df, plan, 9, 600).orderBy("step").collect()]
    lr = model.stages[-1]
    y = [r["y"] for r in df.orderBy("t_idx").collect()]
    for _ in range(9):
        y.append(lr.intercept + lr.coefficients[0] * y[-1] + lr.coefficients[1] * y[-7])
    assert got == pytest.approx(y[-9:], abs=1e-8)
    linear = inference.forecast_linear_lags(inference.last_values(df, 7), [1, 7], list(lr.coefficients), lr.intercept, 9)
    assert [r["forecasted_value"] for r in linear.orderBy("step").collect()] == pytest.approx(got, abs=1e-8)


def test_roll_forecast_moves_the_vector(spark, series):
    _, _, train, _ = _wave(series)
    model = training.fit(training.CANDIDATES["ridge"], train, ["y_lag_1", "y_lag_7"], {"regParam": 0.0})
    last = spark.createDataFrame([(1.0, 2.0)], "y_lag_1 double, y_lag_7 double")
    got = [r["forecasted_value"] for r in inference.forecast_roll(model, last, ["y_lag_1", "y_lag_7"], 11).orderBy("step").collect()]
    lr, x, want = model.stages[-1], [1.0, 2.0], []
    for _ in range(11):
        want.append(lr.intercept + lr.coefficients[0] * x[0] + lr.coefficients[1] * x[1])
        x = [x[1], want[-1]]
    assert got == pytest.approx(want, abs=1e-9)
    vector = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    linear = inference.forecast_linear_roll(vector, list(lr.coefficients), lr.intercept, 11)
    assert [r["forecasted_value"] for r in linear.orderBy("step").collect()] == pytest.approx(want, abs=1e-9)


def test_sampled_attributions_add_up_and_match_linear(series):
    _, _, train, holdout = _wave(series)
    names = ["y_lag_1", "y_lag_7"]
    model = training.fit(training.CANDIDATES["ridge"], train, names, {"regParam": 0.0})
    rows = inference.first_rows(holdout, 5)
    background = inference.first_rows(holdout, 4)
    got = inference.sampled_attributions(model, rows, names, background, permutations=8).collect()
    exact = inference.linear_attributions(rows, names, list(model.stages[-1].coefficients), background).collect()
    want = {(r["row_id"], r["feature"]): r["shap"] for r in exact}
    assert {(r["row_id"], r["feature"]): r["shap"] for r in got} == pytest.approx(want, abs=1e-8)


def test_saved_model_loads(series, tmp_path):
    _, _, train, holdout = _wave(series)
    model = training.fit(training.CANDIDATES["ridge"], train, ["y_lag_1", "y_lag_7"], {"regParam": 0.1})
    paths = training.save_models({"ridge": model}, str(tmp_path), "ridge")
    loaded = training.load_model(paths["best"])
    assert training.score(loaded, holdout) == training.score(model, holdout)


def test_whole_run_on_the_wave(series):
    x = [RNG.random() for _ in range(700)]
    y = [3 * math.sin(2 * math.pi * i / 7) + 0.5 * e for i, e in enumerate(NOISE[:700])]
    run = forecast.forecast_run(series(y, x=x), "y", ["x"], candidates=["ridge"], folds=1, search=False)
    chosen = run.selection.first()
    assert chosen["selected_model"] == "ridge" and chosen["quality_flag"] == "acceptable"
    assert [g["gate"] for g in run.gates.collect() if not g["passed"]] == []
    assert {r["model"] for r in run.benchmarks.collect()} == {"naive_persistence", "arima_benchmark", "kmeans_benchmark"}


def test_a_copy_that_starts_late_is_a_leak(spark):
    """Null in its first 1,000 rows, with a large level and a small spread."""
    from tidecast.functions.stats import correlations

    df = spark.range(3000).selectExpr(
        "id as t_idx", "1.7e9D + 100 * sin(id) as y", "if(id >= 1000, 1.7e9D + 100 * sin(id), null) as copy",
        "cast(null as double) as empty", "1.0D as flat", "if(id = 5, double('NaN'), sin(id)) as holed")
    found = correlations(df, [("copy", "y"), ("empty", "y"), ("flat", "y"), ("holed", "y")])
    assert found[("copy", "y")] == pytest.approx(1.0) and found[("holed", "y")] == pytest.approx(1.0)
    assert found[("empty", "y")] is None and found[("flat", "y")] is None
    marked = {r["feature"]: r["candidate"] for r in leakage.detect_leakage(df, ["copy", "empty", "flat"], "y").collect()}
    assert marked == {"copy": True, "empty": True, "flat": False}


def test_correlations_survive_levels_gaps_and_infinities(spark):
    from tidecast.functions.stats import correlation_states

    df = spark.range(0, 60_000, 1, 7).selectExpr(
        "if(id < 30000, sin(id), 1.7e9D + 100 * sin(id)) as y", "if(id >= 30000, sin(id), null) as late",
        "if(id % 3 = 0, 0.1D, null) as flat", "if(id % 1000 = 7, double('inf'), sin(id)) as holed", "if(id < 30000, 0.3D, 1e9D) as step",
        "if(id = 4, 1D, null) as once", "sin(id) as wave", "double('NaN') as never")
    found = correlation_states(df, [("late", "y"), ("flat", "y"), ("holed", "wave"), ("step", "late"), ("once", "y"), ("never", "y"), ("wave", "wave")])
    assert found[("late", "y")] == (pytest.approx(1.0, abs=1e-6), "known") and found[("wave", "wave")] == (pytest.approx(1.0), "known")
    assert found[("holed", "wave")] == (pytest.approx(1.0), "known")
    assert found[("flat", "y")] == found[("step", "late")] == (None, "constant")
    assert found[("once", "y")] == found[("never", "y")] == (None, "unknown")
    assert correlation_states(df.limit(0), [("late", "y")]) == {("late", "y"): (None, "unknown")}


def test_width_does_not_change_a_correlation(spark):
    cols = [f"if((id + {k}) % 5 = 0, null, sin(id * {k + 1})) as c{k}" for k in range(17)]
    df = spark.range(400).selectExpr(*cols)
    pair = lambda n: next(r["correlation"] for r in profile.correlation_pairs(df, [f"c{k}" for k in range(n)]).collect()
                          if (r["column_a"], r["column_b"]) == ("c0", "c1"))
    assert pair(16) == pytest.approx(pair(17), abs=1e-12)


def test_missing_values_do_not_depend_on_stretches(series):
    from tidecast.operators import order, smoothing

    values = [None if i % 3 == 0 else NOISE[i % len(NOISE)] + i % 7 for i in range(900)]
    whole = [v for v in values if v is not None]
    curves = [{r["lag"]: r["acf"] for r in stattests.acf(series(v), "y", 5).collect()} for v in (values, whole)]
    assert curves[0] == pytest.approx(curves[1], abs=1e-9)
    found = []
    for stretch in (50, order.STRETCH):
        out = smoothing.smooth(series(values), [smoothing.Smoothing(0.3, 0.1)], stretch=stretch).orderBy("t_idx").collect()
        assert [r["t_idx"] for r in out] == [i for i, v in enumerate(values) if v is not None]
        found.append([r["prediction"] for r in out])
    assert found[0] == pytest.approx(found[1], abs=1e-9)


def test_nan_counts_as_null(spark):
    from tidecast.operators import quantiles

    df = spark.range(101).selectExpr("if(id = 7, double('NaN'), double(id)) as x")
    assert quantiles.exact_quantiles(df, ["x"], [0.0, 1.0])["x"] == [0.0, 100.0]


def test_random_search_is_asked_for():
    grid = {"a": list(range(5)), "b": list(range(4))}
    from tidecast.operators import training

    assert len(training.parameter_sets(grid)) == 20 and len(training.parameter_sets(grid, 6)) == 6


def test_feature_groups_and_model_subsets(spark):
    from tidecast.functions.names import feature_groups
    from tidecast.operators import features as fx

    names = ["y_lag_1", "y_rolling_mean_7", "hour", "sin_1"]
    groups = {r["feature_group"]: r["features"] for r in feature_groups(spark.createDataFrame([(n,) for n in names], "feature string")).collect()}
    assert groups["lag"] == 1 and groups["rolling"] == 1
    assert set(fx.model_subsets(names, ["SARIMA", "Linear Models"])) == {"SARIMA", "Linear Models"}


@pytest.mark.parametrize("family", ["random_forest", "extra_trees"])
def test_forests_that_differ_in_depth_share_one_fit(spark, family, monkeypatch):
    """The cut forest predicts and scores as the forest fitted at that depth."""
    draw = np.random.default_rng(5)
    a, b, c = draw.normal(size=(3, 3000))
    y = np.sin(3 * a) + a * b + 0.1 * draw.normal(size=3000)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(y, a, b, c))], "t_idx int, y double, a double, b double, c double")
    rows, names, sets = rows.repartition(3, "t_idx").persist(), ["a", "b", "c"], [{"maxDepth": d, "numTrees": 6} for d in (2, 6, 4)]
    candidate, folds = training.CANDIDATES[family], split.expanding_folds(3000, 2)
    fitted, fit = [], training.fit
    monkeypatch.setattr(training, "fit", lambda *args: fitted.append(args[3]) or fit(*args))
    found = training.cross_validate(candidate, rows, names, folds, sets)
    assert fitted == [sets[1]] * 2  # one fit a fold, not one a depth
    assert [r[1:3] for r in found] == [(str(p), f.fold) for p in sets for f in folds]
    for (p, f), got in zip([(p, f) for p in sets for f in folds], found):
        m = training.score(fit(candidate, rows.where(f.train()), names, p), rows.where(f.test()))
        assert got[3:] == pytest.approx((m["r2"], m["rmse"], m["mae"]), rel=1e-9)
    monkeypatch.setattr(training, "LEVEL_BYTES", 0)
    assert len(training.shared_fits(candidate, names, sets)) == 3
    rows.unpersist()
