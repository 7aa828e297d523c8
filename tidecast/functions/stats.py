"""Aggregates that stay null where the built-in ones would divide by zero."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both are known; null when one is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = a.cast("double"), b.cast("double")
    spread = F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b))
    return F.try_divide(F.regr_sxy(a, b), spread)


KNOWN, CONSTANT, UNKNOWN = "known", "constant", "unknown"
LOST = 1e-6       # a variance below this share of the squares it came from has lost digits
ROUNDING = 1e-15  # a spread below this share of the mean is rounding

_MOMENTS = ["n", "a", "b", "aa", "bb", "ab"]


def _moments(left: list[int], right: list[int]):
    """For each pair of columns of two sets: rows that know both, their means and summed squares around them."""
    def alone(x: np.ndarray, y: np.ndarray) -> list[float]:
        both = np.isfinite(x) & np.isfinite(y)
        x, y = x[both], y[both]
        mx, my = x.mean(), y.mean()
        return [len(x), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()]

    def of_batch(whole: np.ndarray) -> np.ndarray:
        x, known = whole, np.isfinite(whole)
        shift = x[known.argmax(0), np.arange(x.shape[1])]  # a value of the column, so constants stay exact
        shift = np.where(np.isfinite(shift), shift, 0.0)
        x, m = np.where(known, x - shift, 0.0), known.astype(float)
        a, b, ma, mb = x[:, left], x[:, right], m[:, left], m[:, right]
        n, sa, sb, saa, sbb, sab = (u.T @ v for u, v in ((ma, mb), (a, mb), (ma, b), (a * a, mb), (ma, b * b), (a, b)))
        some = np.maximum(n, 1)
        aa, bb = saa - sa * sa / some, sbb - sb * sb / some
        out = np.array([n, shift[left][:, None] + sa / some, shift[right] + sb / some, aa, bb, sab - sa * sb / some])
        for i, j in np.argwhere((aa < LOST * saa) | (bb < LOST * sbb)):  # where a level changes inside a batch
            out[:, i, j] = alone(whole[:, left[i]], whole[:, right[j]])
        return out

    def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, share = x[0] + y[0], y[0] / np.maximum(x[0] + y[0], 1)
        da, db, weight = y[1] - x[1], y[2] - x[2], x[0] * share
        return np.array([n, x[1] + da * share, x[2] + db * share, x[3] + y[3] + da * da * weight,
                         x[4] + y[4] + db * db * weight, x[5] + y[5] + da * db * weight])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_MOMENTS), len(left), len(right)))
        for batch in batches:
            if batch.num_rows:
                total = merged(total, of_batch(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        i, j = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(m[i, j]) for m in total)], names=["i", "j", *_MOMENTS])
    return run


def correlation_states(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], tuple[float | None, str]]:
    """Correlation of column pairs over rows where both are known, and what it is worth.

    ``known``; ``constant`` (None): one of the two does not vary over at least
    two such rows; ``unknown`` (None): there are fewer rows.  NaN and infinite
    values count as null.  One pass at any width: six products of masked
    matrices a batch, merged around their means in the task; tasks put out one
    row a pair, and these are merged around the mean of the largest one.
    """
    if not pairs:
        return {}
    left, right = (list(dict.fromkeys(side)) for side in zip(*pairs))
    cols = list(dict.fromkeys([*left, *right]))
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    found = rows.mapInArrow(_moments([cols.index(c) for c in left], [cols.index(c) for c in right]),
                            "i long, j long, " + ", ".join(f"{c} double" for c in _MOMENTS))
    pair = Window.partitionBy("i", "j")
    around = found.withColumns({f"{c}0": F.max_by(c, "n").over(pair) for c in "ab"})
    da, db = (F.col(c) - F.col(f"{c}0") for c in "ab")
    summed = around.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("a0").alias("a0"), F.first("b0").alias("b0"),
        F.sum(F.col("n") * da).alias("a"), F.sum(F.col("n") * db).alias("b"),
        F.sum(F.col("aa") + F.col("n") * da * da).alias("aa"), F.sum(F.col("bb") + F.col("n") * db * db).alias("bb"),
        F.sum(F.col("ab") + F.col("n") * da * db).alias("ab"))
    asked = {(left.index(a), right.index(b)): (a, b) for a, b in pairs}
    out: dict[tuple[str, str], tuple[float | None, str]] = dict.fromkeys(pairs, (None, UNKNOWN))
    for r in summed.collect():  # one row a pair of columns
        key, n = asked.get((r["i"], r["j"])), r["n"]
        if key is None or n < 2:
            continue
        xx, yy = (r[c + c] - r[c] * r[c] / n for c in "ab")
        flat = not all(v > n * (ROUNDING * (r[f"{c}0"] + r[c] / n)) ** 2 for c, v in (("a", xx), ("b", yy)))
        value = None if flat else (r["ab"] - r["a"] * r["b"] / n) / (xx**0.5 * yy**0.5)
        out[key] = (value, KNOWN) if value is not None and isfinite(value) else (None, CONSTANT)
    return out


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Correlation of column pairs over rows where both are known; None when one is constant or unknown."""
    return {p: r for p, (r, _) in correlation_states(df, pairs).items()}
