"""Exact Shapley values of tree ensembles.

A leaf is reached by a row if the row lies in one interval for each feature on
the leaf's path.  With the others unknown, a feature lets a share of the
training rows through: the product of the shares of its splits.  So a leaf is a
product over its features, and its Shapley values are sums over the powers of
a polynomial with one factor a feature, not over subsets.  Trees are kept as
flat lists of leaves; rows that meet the same intervals of a leaf share one
solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """Value, and for each feature on the path the interval (low, high] and the share of rows let through."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _tree_leaves(tree, weight: float) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            rows = [(f, *path[f]) for f in sorted(path)]
            columns = [np.array(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 4
            out.append(Leaf(weight * node.prediction(), columns[0].astype(int), *columns[1:]))
            return
        split, every = node.split(), node.impurityStats().count()
        if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only numeric splits can be explained")
        feature, cut = split.featureIndex(), split.threshold()
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            walk(child, {**path, feature: (*bounds, share * child.impurityStats().count() / every)})

    walk(tree._call_java("rootNode"), {})
    return out


def leaves(model: PipelineModel) -> list[Leaf]:
    """All leaves of a fitted tree, forest or boosted model, weighted as in its prediction."""
    last = model.stages[-1]
    trees = getattr(last, "trees", [last])
    weights = list(getattr(last, "treeWeights", [1.0]))
    if type(last).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    return [leaf for tree, w in zip(trees, weights) for leaf in _tree_leaves(tree, float(w))]


def base_value(found: Sequence[Leaf]) -> float:
    """What the model predicts for no row in particular: leaves by the training rows that reach them."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in found))


def _solved(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for rows of which intervals are met, one column a feature of its path."""
    m, ones = met.shape[1], met.astype(float)
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.zeros(met.shape)
    for j in range(m):
        powers = np.ones((len(met), 1))  # by how many of the other features are taken from the row
        for i in range(m):
            if i != j:
                grown = np.zeros((len(met), powers.shape[1] + 1))
                grown[:, :-1] = powers * leaf.share[i]
                grown[:, 1:] += powers * ones[:, i: i + 1]
                powers = grown
        out[:, j] = leaf.value * (ones[:, j] - leaf.share[j]) * (powers @ weight)
    return out


def shapley_values(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """One value for each row and feature; NaN goes the way it goes in the model, to the right."""
    out = np.zeros(x.shape)
    for leaf in found:
        if len(leaf.features):
            own = x[:, leaf.features]
            met = (np.isneginf(leaf.low) | ~(own <= leaf.low)) & ((own <= leaf.high) | np.isposinf(leaf.high))
            kinds, kind = np.unique(np.packbits(met, axis=1), axis=0, return_inverse=True)
            patterns = np.unpackbits(kinds, axis=1, count=met.shape[1]).astype(bool)
            out[:, leaf.features] += _solved(leaf, patterns)[kind.ravel()]
    return out


def _nodes(tree, depth: int) -> tuple[np.ndarray, ...]:
    """Feature (-1: a leaf), cut, left child, right child and value of the nodes down to ``depth``."""
    rows: list[list] = []

    def walk(node, left: int) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, node.prediction()])
        if left and node.subtreeDepth():
            split = node.split()
            if not hasattr(split, "threshold"):
                raise ValueError("only numeric splits can be cut")
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2:4] = walk(node.leftChild(), left - 1), walk(node.rightChild(), left - 1)
        return at

    walk(tree._call_java("rootNode"), depth)
    return tuple(np.array(c) for c in zip(*rows))


def cut_predictions(model: PipelineModel, depths: Sequence[int]):
    """A function of the feature columns: the predictions of a forest cut at each of ``depths``, as an array."""
    forest = [_nodes(tree, max(depths)) for tree in model.stages[-1].trees]

    def run(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        rows, out = np.arange(len(x)), np.zeros((len(x), len(depths)))
        for feature, cut, left, right, value in forest:
            node = np.zeros(len(x), dtype=int)
            for level in range(max(depths) + 1):
                out[:, [d == level for d in depths]] += value[node][:, None]
                node = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])  # a leaf leads to itself
        ends = np.arange(0, out.size + 1, len(depths), dtype=np.int32)
        return pa.ListArray.from_arrays(ends, (out / len(forest)).ravel())

    return F.arrow_udf(run, "array<double>")


def _explained(found: list[Leaf], features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(float)
            values = shapley_values(found, x)
            n = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(n), len(features)))), pa.array(features * n, pa.string()),
                pa.array(x.ravel()), pa.array(values.ravel())], names=["row_id", "feature", "value", "shap"])
    return run


def tree_attributions(model: PipelineModel, rows: DataFrame, features: Sequence[str], row_id: str = "t_idx") -> DataFrame:
    """``row_id, feature, value, shap`` of every row, exact; a row's values add up to prediction minus ``base_value``.

    ``features`` are the columns the model was fitted on, in order.  One map
    over the rows; the leaves, as many as the model has, go with the task.
    """
    source = rows.select(F.col(row_id).alias("row_id"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    kind = source.schema["row_id"].dataType.simpleString()
    return source.mapInArrow(_explained(leaves(model), list(features)), f"row_id {kind}, feature string, value double, shap double")
