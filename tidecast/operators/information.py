"""Mutual information from quantile bins, and the noise it is compared with."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import inf, log, nan, nextafter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.noise import add_standard_normals
from tidecast.operators.order import over_order
from tidecast.operators.quantiles import exact_quantiles
from tidecast.storage import spread_out

BINS = 8
NOISE_COLUMNS = 5
FAR, LEAST_SPREAD = 3.0, 0.05


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    return exact_quantiles(df, cols, [i / bins for i in range(1, bins)])


def with_bins(df: DataFrame, edges: dict[str, Sequence[float]], prefix: str = "_bin_") -> DataFrame:
    """Add how many edges lie strictly below each value; equal values always share a bin."""
    splits = []
    for values in edges.values():
        inner = sorted({nextafter(e, inf) for e in values if e is not None})
        splits.append([-inf, *inner, inf] if inner else [-inf, 0.0, inf])
    finder = Bucketizer(
        inputCols=list(edges), outputCols=[f"{prefix}{c}" for c in edges], splitsArray=splits, handleInvalid="keep"
    )
    # NaN counts as null
    binned = finder.transform(df.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(nan)) for c in edges}))
    return binned.withColumns({f"{prefix}{c}": F.col(f"{prefix}{c}").cast("int") for c in edges})


def joint_counts(
    binned: DataFrame, columns: dict[object, str], target: str, label: str, bins: int = BINS, keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, label, xbin, ybin, n`` of bin columns against the target's, nulls left out.

    ``columns`` maps labels to bin columns.  Every batch is counted in one array
    a column, so what leaves a task are counters, not a row for each row and
    column.
    """
    keys, labels = list(keys), list(columns)
    wide, size = [*columns.values(), target], bins * bins
    types = {f.name: f.dataType.simpleString() for f in binned.schema.fields}
    kind = "string" if isinstance(labels[0], str) else "int"
    names = [*keys, label, "xbin", "ybin", "n"]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"{label} {kind}", "xbin int, ybin int, n bigint"])

    def counted(batch: pa.RecordBatch, group: np.ndarray, groups: int) -> np.ndarray:
        codes = [pc.fill_null(batch.column(len(keys) + i), -1).to_numpy() for i in range(len(wide))]
        y, out = codes[-1], np.zeros((groups, len(labels), size), np.int64)
        for i, x in enumerate(codes[:-1]):
            both = (x >= 0) & (y >= 0)
            cell = (group[both] * bins + x[both]) * bins + y[both]
            out[:, i] = np.bincount(cell, minlength=groups * size).reshape(groups, size)
        return out

    def table(counts: np.ndarray, own: list[pa.Array]) -> pa.RecordBatch:
        g, i, cell = np.nonzero(counts)
        place = pa.array(g)
        return pa.RecordBatch.from_arrays([
            *(k.take(place) for k in own), pa.array([labels[j] for j in i], pa.string() if kind == "string" else pa.int32()),
            pa.array((cell // bins).astype(np.int32)), pa.array((cell % bins).astype(np.int32)), pa.array(counts[g, i, cell])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((1, len(labels), size), np.int64)
        for batch in batches:
            if not keys:
                whole += counted(batch, np.zeros(batch.num_rows, np.int64), 1)
            elif batch.num_rows:
                series = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(keys)}).groupby(keys, sort=False, dropna=False)
                group = series.ngroup().to_numpy()
                firsts = pa.array(np.unique(group, return_index=True)[1])
                yield table(counted(batch, group, len(firsts)), [batch.column(i).take(firsts) for i in range(len(keys))])
        if not keys:
            yield table(whole, [])

    return binned.select(*keys, *wide).mapInArrow(run, schema)


def _information(joint: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mutual information per key from counters of (key, xbin, ybin): at most bins squared per key."""
    joint = joint.groupBy(*keys, "xbin", "ybin").agg(F.sum("n").alias("n"))
    share = joint.select(
        *keys,
        (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("p"),
        (F.sum("n").over(Window.partitionBy(*keys, "xbin"))
         / F.sum("n").over(Window.partitionBy(*keys))).alias("px"),
        (F.sum("n").over(Window.partitionBy(*keys, "ybin"))
         / F.sum("n").over(Window.partitionBy(*keys))).alias("py"),
    )
    term = F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))
    return share.groupBy(*keys).agg(F.sum(term).alias("mi"))


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, bins: int = BINS,
    known_edges: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    """``(feature, mi)`` for every feature against the target; null pairs left out.

    Columns with ``known_edges`` need no pass to find their quantiles.
    """
    known = dict(known_edges or {})
    asked = [c for c in dict.fromkeys([*features, target]) if c not in known]
    edges = {**(bin_edges(df, asked, bins) if asked else {}), **known}
    binned, columns = with_bins(df, edges), {f: f"_bin_{f}" for f in dict.fromkeys(features)}
    return _information(joint_counts(binned, columns, f"_bin_{target}", "feature", bins), ["feature"])


def with_noise(df: DataFrame, key: Column, count: int = NOISE_COLUMNS) -> tuple[DataFrame, list[str]]:
    """Add standard normal columns drawn from the row key."""
    names = [f"noise_{i}" for i in range(count)]
    return add_standard_normals(df, key, "noise", names), names


def noise_edges(names: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Equal-probability edges of the noise columns, known because their distribution is."""
    edges = [NormalDist().inv_cdf(i / bins) for i in range(1, bins)]
    return {n: edges for n in names}


def information_ranking(
    df: DataFrame, features: Sequence[str], target: str, key: Column, bins: int = BINS
) -> tuple[DataFrame, float]:
    """Ranking of the features and the mean information of pure noise.

    Features and noise go through the same estimator, so its bias cancels in
    the comparison.
    """
    asked = list(dict.fromkeys([*features, target]))
    edges = bin_edges(df, asked, bins)
    rows = spread_out(df.select(*asked, key.alias("_key")))
    noisy, names = with_noise(rows, F.col("_key"))
    known = {**edges, **noise_edges(names, bins)}
    scored = mutual_information(noisy, [*features, *names], target, bins, known)
    # One row per column is collected.
    scores = {row["feature"]: row["mi"] for row in scored.collect()}
    noise = [scores.get(n, 0.0) for n in names]
    baseline = sum(noise) / len(noise)
    rows = sorted(((f, scores.get(f, 0.0)) for f in features), key=lambda s: (-round(s[1], 6), s[0]))
    ranking = df.sparkSession.createDataFrame(
        [(f, mi, mi <= baseline) for f, mi in rows],
        "feature string, mi_score double, below_noise_baseline boolean",
    )
    return ranking, baseline


def anomalous_information(df: DataFrame, features: Sequence[str], target: str, bins: int = BINS) -> DataFrame:
    """``feature, mi, fence, leakage_suspect``: features that tell far more of the target than the others do.

    The fence is the upper quartile of all scores and ``FAR`` times the spread
    between the quartiles (interpolated; at least ``LEAST_SPREAD`` of the
    information a copy would have), so a few leaks do not move it.  A map of
    the target is found whatever its shape, also where the correlation is 0.
    """
    found = {r["feature"]: r["mi"] for r in mutual_information(df, features, target, bins).collect()}  # one row a column
    scores = [max(found.get(f) or 0.0, 0.0) for f in features]
    q1, q3 = np.percentile(scores, [25, 75]) if scores else (0.0, 0.0)
    fence = float(q3 + FAR * max(q3 - q1, LEAST_SPREAD * log(bins)))
    rows = [(f, s, fence, s > fence) for f, s in zip(features, scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, mi double, fence double, leakage_suspect boolean")


def lag_information(
    df: DataFrame, col: str, max_lag: int = 48, series_cols: Sequence[str] = (), bins: int = BINS
) -> DataFrame:
    """``(lag, mutual_information)`` of the series with its own past.

    Both sides have the same distribution, so the series is binned once and the
    bin numbers are lagged.
    """
    series = df.select(*series_cols, "t_idx", F.col(col).cast("double").alias("y"))
    binned = with_bins(series, bin_edges(series, ["y"], bins)).select(
        *series_cols, "t_idx", F.col("_bin_y").alias("ybin")
    )
    lagged = over_order(
        binned,
        lambda w: {f"b{k}": F.lag("ybin", k).over(w) for k in range(1, max_lag + 1)},
        behind=max_lag,
        series_cols=series_cols,
    )
    counts = joint_counts(lagged, {k: f"b{k}" for k in range(1, max_lag + 1)}, "ybin", "lag", bins, series_cols)
    return _information(counts, [*series_cols, "lag"]).withColumnRenamed("mi", "mutual_information")


def first_local_minimum(curve: DataFrame, value: str = "mutual_information", search: int = 20,
                        series_cols: Sequence[str] = ()) -> DataFrame:
    """Smallest lag whose value is below both neighbours; the overall minimum if there is none."""
    w = Window.partitionBy(*series_cols).orderBy("lag")
    v = F.round(value, 9)
    near = curve.where(F.col("lag") <= search).select(
        *series_cols, "lag", v.alias("v"),
        F.lag(v).over(w).alias("before"), F.lead(v).over(w).alias("after"),
    )
    dip = (F.col("v") < F.col("before")) & (F.col("v") < F.col("after"))
    return near.groupBy(*series_cols).agg(
        F.coalesce(F.min(F.when(dip, F.col("lag"))), F.min_by("lag", F.struct("v", "lag"))).alias("delay")
    )
