"""Periods nobody named: an averaged periodogram, a long autocorrelation, and the peaks of both.

A series is cut into segments of equal length.  Each segment loses its straight
line and goes through one Fourier transform, which gives its power at every
frequency and its lagged products.  Both are sums over segments, so they are
partial before the shuffle and no task holds more than a segment.  Missing
values keep their place and weigh nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.order import join_keys
from tidecast.storage import written_table

SEGMENT = 4096
NEIGHBOURS = 16   # frequencies to each side that a peak is compared with
PEAK_RATIO = 6.0  # of a peak's power to the median of its neighbours
PEAK_ACF = 0.1


def segment_sums(residual: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Power at frequencies 0..size/2 over the size, lagged products up to size/2, and how many of these there are."""
    size, half = len(residual), len(residual) // 2
    power = np.abs(np.fft.rfft(residual)) ** 2
    products = np.fft.irfft(np.abs(np.fft.rfft(residual, 2 * size)) ** 2)[: half + 1]
    pairs = np.rint(np.fft.irfft(np.abs(np.fft.rfft(known.astype(float), 2 * size)) ** 2)[: half + 1])
    return power, products, pairs


def without_line(at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Residuals of the straight line through the values."""
    at, y = at - at.mean(), y - y.mean()
    spread = (at * at).sum()
    return y - at * ((at * y).sum() / spread) if spread > 0 else y


def _segment(n_keys: int, names: list[str]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        size = rows.column("_size")[0].as_py()
        at = rows.column("t_idx").to_numpy() % size
        y = rows.column("y").to_numpy(zero_copy_only=False).astype(float)
        seen = np.isfinite(y)
        residual, known = np.zeros(size), np.zeros(size, bool)
        if seen.any():
            residual[at[seen]], known[at[seen]] = without_line(at[seen], y[seen]), True
        power, products, pairs = segment_sums(residual, known)
        half = size // 2
        place = np.concatenate([np.arange(1, half + 1), np.arange(half + 1)])
        total = len(place)
        columns = [pa.array([key[i].as_py()] * total, key[i].type) for i in range(n_keys)]
        columns += [
            pa.array(np.full(total, size)), pa.array(np.repeat(["power", "product"], [half, half + 1])), pa.array(place),
            pa.array(np.concatenate([power[1: half + 1], products])), pa.array(np.concatenate([np.full(half, float(known.sum())), pairs]))]
        return pa.table(dict(zip(names, columns)))
    return run


def _segment_sums(df: DataFrame, col: str, series_cols: Sequence[str], segment: int) -> DataFrame:
    """``size, kind, place, value, weight`` of each series: sums over its segments."""
    keys = list(series_cols)
    rows = df.select(*keys, "t_idx", F.col(col).cast("double").alias("y"))
    size = F.least(F.lit(segment).cast("long"), F.max("t_idx") + 1)
    lengths = rows.groupBy(*keys).agg(size.alias("_size"))
    if keys:
        sized = join_keys(rows, lengths, keys)
    else:
        sized = rows.withColumn("_size", F.lit((lengths.first() or [None])[0] or 1).cast("long"))
    names = [*keys, "size", "kind", "place", "value", "weight"]
    schema = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(
        "size long, kind string, place long, value double, weight double").fields])
    pieces = sized.withColumn("_segment", F.expr("t_idx div _size")).groupBy(*keys, "_segment").applyInArrow(
        _segment(len(keys), names), schema)
    return pieces.groupBy(*keys, "size", "kind", "place").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))


def _power(sums: DataFrame, keys: list[str]) -> DataFrame:
    near = Window.partitionBy(*keys).orderBy("frequency")
    power = sums.where("kind = 'power' and weight > 0").select(
        *keys, "size", F.col("place").alias("frequency"), (F.col("value") / F.col("weight")).alias("power"))
    share = F.try_divide("power", F.sum("power").over(Window.partitionBy(*keys)))
    around = F.percentile("power", F.lit(0.5)).over(near.rowsBetween(-NEIGHBOURS, NEIGHBOURS))
    return power.withColumns({
        "period": F.col("size") / F.col("frequency"), "power_share": share, "power_ratio": F.try_divide("power", around),
        "_peak": (F.col("power") > F.coalesce(F.lag("power").over(near), F.lit(0.0)))
        & (F.col("power") >= F.coalesce(F.lead("power").over(near), F.lit(0.0)))})


def _curve(sums: DataFrame, keys: list[str]) -> DataFrame:
    mean = sums.where("kind = 'product' and weight > 0").select(
        *keys, F.col("place").alias("lag"), (F.col("value") / F.col("weight")).alias("m"), "weight")
    zero = mean.where("lag = 0").select(*keys, F.col("m").alias("m0"))
    both = join_keys(mean, zero, keys) if keys else mean.withColumn("m0", F.max(F.when(F.col("lag") == 0, F.col("m"))).over(
        Window.partitionBy()))
    return both.where("lag > 0").select(*keys, "lag", F.try_divide("m", "m0").alias("acf"), F.col("weight").cast("long").alias("pairs"))


def periodogram(df: DataFrame, col: str, series_cols: Sequence[str] = (), segment: int = SEGMENT) -> DataFrame:
    """``frequency, period, power, power_share, power_ratio`` of each series, averaged over its segments.

    ``frequency`` counts waves in a segment; ``power_ratio`` compares with the
    median of the frequencies around.  Null, NaN and infinite values weigh
    nothing.  Series shorter than ``segment`` are one segment of their length.
    """
    keys = list(series_cols)
    return _power(_segment_sums(df, col, keys, segment), keys).drop("size", "_peak")


def long_acf(df: DataFrame, col: str, series_cols: Sequence[str] = (), segment: int = SEGMENT) -> DataFrame:
    """``lag, acf, pairs`` up to half a segment, from the pairs inside segments without their lines."""
    keys = list(series_cols)
    return _curve(_segment_sums(df, col, keys, segment), keys)


def find_periods(df: DataFrame, col: str, series_cols: Sequence[str] = (), segment: int = SEGMENT) -> DataFrame:
    """``period, acf, power_ratio, rank`` of whole-number periods that power and autocorrelation agree on.

    A peak of power stands for the lags that its frequency cannot tell apart;
    the one with the largest autocorrelation counts if it tops the middle of the
    curve from an eighth to a quarter of a period away, on both sides.  So
    harmonics (no peak of the curve) and multiples (no power) drop out.  Periods of one row, of a single wave in a
    segment, and flat series give none.  The top of a long smooth wave is flat,
    so noise may move its period by a row.
    """
    keys = list(series_cols)
    sums = written_table(_segment_sums(df, col, keys, segment), "spectra")
    size, frequency = F.col("size"), F.col("frequency")
    peaks = _power(sums, keys).where(F.col("_peak") & (F.col("power_ratio") >= PEAK_RATIO) & (frequency >= 2)).select(
        *keys, "frequency", "power_ratio", F.explode(F.expr(
            "sequence(greatest(2, ceil(size / (frequency + 0.5D))), greatest(2, floor(size / (frequency - 0.5D))))")).alias("lag"))
    curve = _curve(sums, keys)
    best = join_keys(peaks, curve.select(*keys, "lag", "acf"), [*keys, "lag"]).groupBy(*keys, "frequency", "power_ratio").agg(
        F.max_by(F.struct("lag", "acf"), F.struct(F.round("acf", 6), -F.col("lag"))).alias("x")).select(*keys, "power_ratio", "x.*")
    step = F.greatest(F.lit(1), F.floor(F.col("lag") / 8)).cast("long")
    beside = best.select(*keys, F.col("lag").alias("_of"), F.explode(F.concat(
        F.sequence(F.col("lag") - 2 * step, F.col("lag") - step), F.sequence(F.col("lag") + step, F.col("lag") + 2 * step))).alias("lag"))
    middle = lambda c: F.percentile(F.when(c, F.col("acf")), F.lit(0.5))
    sides = join_keys(beside.distinct(), curve.select(*keys, "lag", "acf"), [*keys, "lag"]).groupBy(*keys, "_of").agg(
        middle(F.col("lag") < F.col("_of")).alias("before"), middle(F.col("lag") > F.col("_of")).alias("after")).withColumnRenamed("_of", "lag")
    none = F.lit(-1.0)
    tops = join_keys(best, sides, [*keys, "lag"]).where(
        (F.col("acf") > PEAK_ACF) & (F.col("acf") > F.coalesce("before", none)) & (F.col("acf") > F.coalesce("after", none)))
    once = tops.groupBy(*keys, F.col("lag").alias("period")).agg(F.max("acf").alias("acf"), F.max("power_ratio").alias("power_ratio"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("acf", 6).desc(), "period"))
    return once.withColumn("rank", place)
