"""Gradient boosted trees, many training sets fitted side by side by the same passes over the rows.

A pass adds up, for every fit, the rows and residuals of one level of its next tree by
column and bin.  Bins, splits, residuals and stopping rules are those of ``GBTRegressor``
with squared loss, so the trees are too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMETERS = {"maxDepth": 5, "maxIter": 20, "stepSize": 0.1, "maxBins": 32}  # as preset
DRIVER_TASKS = 32  # tables of more tasks are first added up by other tasks
DEALT = 10_000  # rows a task from which on rows are dealt evenly
EPSILON = 2.0**-52
CLOSED = -2  # in place of a column while a tree grows: a leaf for good


@dataclass
class Tree:
    """Nodes by heap number (children of i: 2i and 2i + 1): column or -1, cut, bin of the cut, value; statistics by node."""

    feature: np.ndarray
    cut: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: dict[int, float] = field(default_factory=dict)
    stats: dict[int, np.ndarray] = field(default_factory=dict)  # rows, sum and sum of squares

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return cls(np.full(size, -1), np.zeros(size), np.zeros(size, dtype=int), np.zeros(size))

    def leaf_of(self, columns: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
        """Where each row is after so many levels; ``columns`` and ``cuts`` are values, or bins."""
        node, at = np.ones(columns.shape[1], dtype=int), np.arange(columns.shape[1])
        for _ in range(levels):
            feature = self.feature[node]
            node = np.where(feature < 0, node, 2 * node + (columns[feature, at] > cuts[node]))
        return node


@dataclass
class Boosted:
    """Trees and their weights; scores rows like the Spark model, which ``model`` makes."""

    trees: list[Tree]
    weights: list[float]
    features: list[str]
    depth: int

    def transform(self, rows: DataFrame) -> DataFrame:
        light = [(Tree(t.feature, t.cut, t.bin, t.value), w) for t, w in zip(self.trees, self.weights)]
        depth = self.depth

        def run(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
            if np.isnan(x).any():
                raise ValueError("null or NaN values in the columns of trees")
            return pa.array(sum(w * t.value[t.leaf_of(x, t.cut, depth)] for t, w in light))

        columns = [F.col(f"`{c}`").cast("double") for c in self.features]
        return rows.withColumn("prediction", F.arrow_udf(run, "double")(*columns))

    def model(self, spark, estimator):
        """The model that ``estimator`` would have given."""
        sc, jvm = spark.sparkContext, spark.sparkContext._jvm
        ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity

        def node(tree: Tree, i: int):
            n, total, squares = tree.stats[i]
            stats = impurity.VarianceCalculator(_py2java(sc, Vectors.dense([n, total, squares])).toArray(), int(n))
            spread = _spread((n, total, squares))
            if tree.feature[i] >= 0:
                left, right = node(tree, 2 * i), node(tree, 2 * i + 1)
                if left[1] is None or left[1] != right[1]:
                    split = ml.tree.ContinuousSplit(int(tree.feature[i]), float(tree.cut[i]))
                    return ml.tree.InternalNode(total / n, spread, float(tree.gain[i]), left[0], right[0], split, stats), None
            return ml.tree.LeafNode(total / n, spread, stats), total / n

        trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(self.trees))
        weights = _py2java(sc, Vectors.dense(self.weights)).toArray()
        for k, tree in enumerate(self.trees):
            trees[k] = ml.regression.DecisionTreeRegressionModel(f"{estimator.uid}_{k}", node(tree, 1)[0], len(self.features))
        found = ml.regression.GBTRegressionModel(estimator.uid, trees, weights, len(self.features))
        return estimator._copyValues(estimator._create_model(found))


def thresholds(values: np.ndarray, expected: float, bins: int) -> np.ndarray:
    """Cuts of a column between its sampled values, so that about as many of ``expected`` rows lie between any two."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    zeros = expected - counts.sum()
    if len(found) and zeros > EPSILON * counts.sum() * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, zeros)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    out, stride = [], expected / bins
    target, total = stride, counts[0]
    for i in range(1, len(found)):
        before, total = total, total + counts[i]
        if abs(before - target) < abs(total - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _sampled(rows: DataFrame, count: int, bins: int, seed: int) -> tuple[np.ndarray, float]:
    """Rows that the cuts are taken from, and how many were to be expected: all, or about 10,000 drawn as Spark's trees do."""
    wanted = max(bins * bins, 10_000)
    if wanted < count:
        spark = rows.sparkSession
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = rows._jdf.toJavaRDD().sample(False, wanted / count, draw)
        rows = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    found = rows.toArrow()
    return np.stack([c.to_numpy() for c in found.columns]), count * min(1.0, wanted / count)


@dataclass(frozen=True)
class _Fit:
    group: int  # of fits over the same rows and bins
    depth: int
    trees: int
    step: float


def _dealt(rows: DataFrame, features: Sequence[str], groups: Sequence[tuple[float, list[np.ndarray]]], fits: Sequence[_Fit], deal: bool) -> RDD:
    """Blocks of some thousand rows: target and bins of each group, and the predictions of each fit, before there are trees."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lines = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array([lines.tobytes()], pa.binary())], names=["block"])

    def binned(row) -> tuple[dict, dict]:
        lines, out = np.frombuffer(row[0]).reshape(len(features) + 2, -1), {}
        for g, (end, cuts) in enumerate(groups):
            use = lines[0] < end
            if use.any():
                kind = np.uint8 if max(map(len, cuts)) < 256 else np.int32
                x = lines[2:, use]
                out[g] = lines[1, use], np.stack([np.searchsorted(c, v).astype(kind) for c, v in zip(cuts, x)])
        return out, {i: np.zeros(len(out[f.group][0])) for i, f in enumerate(fits) if f.group in out}

    columns = ["t_idx", "y", *features]
    blocks = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(pack, "block binary")
    if deal:
        blocks = blocks.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return blocks.rdd.map(binned).persist(StorageLevel.MEMORY_AND_DISK)


def _tables(level: int, first: bool, fits: dict[int, _Fit], trees: dict[int, Tree], bins: Sequence[int]):
    """Rows, residuals and their squares by node of a level, column and bin."""
    def run(blocks: Iterator[tuple]) -> Iterator[dict]:
        out: dict[int, np.ndarray] = {}
        for found, predictions in blocks:
            for i, fit in fits.items():
                if fit.group not in found:
                    continue
                y, x = found[fit.group]
                rest = y if first else 2 * (y - predictions[i])
                node = trees[i].leaf_of(x, trees[i].bin, level)
                open_ = (node >= 2**level) & (trees[i].feature[node] == -1)
                if not open_.all():
                    node, x, rest = node[open_], x[:, open_], rest[open_]
                width, count = bins[fit.group], 2**level
                start = (node - count) * width
                if i not in out:
                    out[i] = np.zeros((3, len(x), count * width))
                weights = [None, rest, rest * rest]
                for j, column in enumerate(x):
                    at = start + column
                    for k, w in enumerate(weights):
                        out[i][k, j] += np.bincount(at, w, minlength=count * width)
        yield out
    return run


def _added(a: dict, b: dict) -> dict:
    return a | b | {i: a[i] + b[i] for i in a.keys() & b.keys()}


def _spread(stats: np.ndarray) -> np.ndarray:
    """Variance from rows, sum and sum of squares."""
    return (stats[2] - stats[1] * stats[1] / stats[0]) / stats[0]


def _split(tree: Tree, level: int, table: np.ndarray, cuts: list[np.ndarray], width: int) -> None:
    """Give the nodes of a level their best splits, of equal ones the first; a node without one stays a leaf."""
    table = table.reshape(3, len(cuts), 2**level, width)
    usable = np.arange(width) < np.array([len(c) for c in cuts])[:, None]
    for k in range(2**level):
        node = 2**level + k
        left = np.cumsum(table[:, :, k], 2)
        right = left[:, :, -1:] - left
        if not left[0, 0, -1]:
            continue
        if level == 0:
            tree.stats[node] = left[:, 0, 0] + right[:, 0, 0]
            tree.value[node] = tree.stats[node][1] / tree.stats[node][0]
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = left[0] / left[0, 0, -1], right[0] / left[0, 0, -1]
            gain = _spread(tree.stats[node]) - shares[0] * _spread(left) - shares[1] * _spread(right)
        gain = np.where(usable & (left[0] >= 1) & (right[0] >= 1), gain, -np.inf)
        column, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not gain[column, at] > 0:
            tree.feature[node] = CLOSED
            continue
        tree.feature[node], tree.bin[node], tree.cut[node] = column, at, cuts[column][at]
        tree.gain[node] = gain[column, at]
        for child, side in ((2 * node, left), (2 * node + 1, right)):
            tree.stats[child] = side[:, column, at]
            tree.value[child] = tree.stats[child][1] / tree.stats[child][0]
            if abs(_spread(tree.stats[child])) < EPSILON:
                tree.feature[child] = CLOSED


def _grown(state: RDD, first: bool, fits: dict[int, _Fit], groups: Sequence[tuple], bins: Sequence[int]) -> dict[int, Tree]:
    """The next tree of each fit, a pass a level."""
    trees = {i: Tree.empty(f.depth) for i, f in fits.items()}
    for level in range(max(f.depth for f in fits.values())):
        asked = {i: f for i, f in fits.items() if f.depth > level and (
            level == 0 or any(trees[i].feature[k // 2] >= 0 and trees[i].feature[k] == -1 for k in range(2**level, 2 ** (level + 1))))}
        if not asked:
            break
        light = {i: Tree(trees[i].feature, trees[i].cut, trees[i].bin, trees[i].value) for i in asked}
        parts = state.mapPartitions(_tables(level, first, asked, light, bins))
        if state.getNumPartitions() > DRIVER_TASKS:
            total = parts.treeReduce(_added)
        else:
            total = {}
            for part in parts.collect():
                total = _added(total, part)
        for i, table in total.items():
            _split(trees[i], level, table, groups[fits[i].group][1], bins[fits[i].group])
    return trees


def _boosted(trees: dict[int, Tree], weights: dict[int, float], fits: dict[int, _Fit]):
    def run(block: tuple) -> tuple:
        found, predictions = block
        out = {}
        for i, tree in trees.items():
            if i in predictions:
                x = found[fits[i].group][1]
                out[i] = predictions[i] + weights[i] * tree.value[tree.leaf_of(x, tree.bin, fits[i].depth)]
        return found, out
    return run


def fit_boosted(
    rows: DataFrame, features: list[str], sets: Sequence[tuple[dict, int | None]], seed: int,
    in_parallel: Callable[[list], list],
) -> list[Boosted]:
    """Boosted trees of each pair of parameters and the end of the training rows; none: all rows."""
    params = [PARAMETERS | p for p, _ in sets]
    ends = [float("inf") if end is None else end for _, end in sets]
    whole = float("inf") in ends
    used = rows if whole else rows.where(F.col("t_idx") < max(ends))
    if ends.count(float("inf")) == len(ends):
        used = used.withColumn("t_idx", F.lit(0))  # not needed, and may not be there
    until = lambda end: used if end == float("inf") else used.where(F.col("t_idx") < end)
    distinct = list(dict.fromkeys(ends))
    y = F.col("y").cast("double")
    bad = [F.count_if(F.isnull(f"`{c}`") | F.isnan(F.col(f"`{c}`").cast("double"))) for c in features]
    counts = used.agg(
        F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))), sum(bad, F.lit(0)),
        *[F.count_if(F.col("t_idx") < F.lit(float(end))) for end in distinct]).first()
    if counts[0] or counts[1]:
        raise ValueError("null, NaN or infinite values in the target, or null or NaN in the columns of trees")
    sizes = dict(zip(distinct, counts[2:]))
    if not all(sizes.values()):
        raise ValueError("trees need training rows")
    keys = list(dict.fromkeys((end, min(p["maxBins"], sizes[end])) for p, end in zip(params, ends)))

    def cuts(end, bins):
        found, expected = _sampled(until(end).select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(features)]),
                                   sizes[end], bins, seed)
        return end, [thresholds(v, expected, bins) for v in found]

    groups = in_parallel([lambda k=k: cuts(*k) for k in keys])
    bins = [max(map(len, c)) + 1 for _, c in groups]
    fits = {i: _Fit(keys.index((end, min(p["maxBins"], sizes[end]))), p["maxDepth"], p["maxIter"], p["stepSize"])
            for i, (p, end) in enumerate(zip(params, ends))}
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    state = _dealt(used, features, groups, list(fits.values()), max(sizes.values()) > DEALT * tasks)
    out = [Boosted([], [], list(features), f.depth) for f in fits.values()]
    before = None
    try:
        for m in range(max(f.trees for f in fits.values())):
            growing = {i: f for i, f in fits.items() if f.trees > m}
            trees = _grown(state, m == 0, growing, groups, bins)
            if before is not None:
                before.unpersist()
            weights = {i: f.step if m else 1.0 for i, f in growing.items()}
            for i, tree in trees.items():
                tree.feature[tree.feature < 0] = -1
                out[i].trees.append(tree)
                out[i].weights.append(weights[i])
            going_on = {i: trees[i] for i, f in growing.items() if f.trees > m + 1}
            if going_on:
                light = {i: Tree(t.feature, t.cut, t.bin, t.value) for i, t in going_on.items()}
                state, before = state.map(_boosted(light, weights, fits)).persist(StorageLevel.MEMORY_AND_DISK), state
    finally:
        for kept in (before, state):
            if kept is not None:
                kept.unpersist()
    return out
