"""Split windows, positions, forward fill and quantiles against plain definitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.operators import order, quantiles, split


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(1)
    rows = []
    for name, n in (("a", 700), ("b", 60), ("c", 1), (None, 40)):
        for i in range(n):
            # Half of all rows share one timestamp.
            t = 5 if i % 2 else rng.randrange(1000)
            rows.append((name, t, len(rows), rng.random() if rng.random() > 0.9 else None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "name string, t int, id int, v double")


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_positions_match_row_number(spark, panel, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = order.dense_index(panel, ["t", "id"], ["name"]).collect()
        alone = order.dense_index(panel, ["t", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(panel.collect(), key=lambda r: (r["t"], r["id"]))
    seen, want = {}, {}
    for r in rows:
        want[r["id"]] = seen.setdefault(r["name"], 0)
        seen[r["name"]] += 1
    assert {r["id"]: r["t_idx"] for r in got} == want
    assert {r["id"]: r["t_idx"] for r in alone} == {r["id"]: i for i, r in enumerate(rows)}


def test_split_window_equals_global_window(panel):
    indexed = order.dense_index(panel, ["t", "id"], ["name"])

    def build(w):
        return {
            "l5": F.lag("id", 5).over(w), "n3": F.lead("id", 3).over(w),
            "s": F.sum("id").over(w.rowsBetween(-5, -1)),
        }

    whole = build(Window.partitionBy("name").orderBy("t_idx"))
    want = {r["id"]: (r["l5"], r["n3"], r["s"]) for r in indexed.select("id", *[c.alias(n) for n, c in whole.items()]).collect()}
    split = order.over_order(indexed, build, behind=5, ahead=3, series_cols=["name"], stretch=50)
    assert {r["id"]: (r["l5"], r["n3"], r["s"]) for r in split.collect()} == want


def test_last_known_over_many_levels(panel):
    indexed = order.dense_index(panel, ["t", "id"], ["name"])
    filled = order.last_known(indexed, "v", "f", ["name"], stretch=4).collect()
    want, last = {}, {}
    for r in sorted(indexed.collect(), key=lambda r: (r["name"] or "", r["t_idx"])):
        last[r["name"]] = r["v"] if r["v"] is not None else last.get(r["name"])
        want[r["id"]] = last[r["name"]]
    assert {r["id"]: r["f"] for r in filled} == want


@pytest.mark.parametrize("at_once", [100_000, 40, 2])
def test_quantiles_with_heavy_ties(spark, monkeypatch, at_once):
    monkeypatch.setattr(quantiles, "RANKED_AT_ONCE", at_once)
    rng = random.Random(7)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), 7.0 if i % 3 == 0 else rng.random(), None if i % 5 else float(i), 1.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, df.columns, probs)
    for i, c in enumerate(df.columns):
        v = sorted(r[i] for r in rows if r[i] is not None)
        want = []
        for p in probs:
            at = p * (len(v) - 1)
            lo, hi = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            want.append(lo + (hi - lo) * (at - int(at)))
        assert got[c] == pytest.approx(want, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_splits_keep_the_unnamed_series(panel):
    indexed = order.dense_index(panel, ["t", "id"], ["name"])
    train, holdout = split.chronological(indexed, ["name"])
    assert train.count() + holdout.count() == panel.count()
    assert holdout.where("name is null").count() == 8
    assert split.test_folds(indexed, ["name"]).count() == panel.count()
