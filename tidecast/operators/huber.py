"""Huber regressions on random waves, many training sets fitted side by side by the same passes over the rows.

A pass gives the loss and the gradient of every fit that is not finished.  The search of
each fit is a generator on the driver that asks for one point at a time; objective, steps
and stopping rules are those of ``LinearRegression(loss="huber")``, so the fits are too.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows of an array that is kept
CHUNK = 1024  # rows worked on at once: their waves stay in the processor's cache
TINY = 5e-324  # the scale of the residuals stays above zero


def packed(rows: DataFrame, columns: Sequence[str], what: str) -> RDD:
    """Arrays of some thousand rows each, one line a column, dealt evenly; null, NaN and infinite values are refused."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not np.isfinite(lines).all():
                raise ValueError(f"null, NaN or infinite values in the columns of {what}")
            parts = [lines[:, i: i + BLOCK].tobytes() for i in range(0, batch.num_rows, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["block"])

    count, tasks = len(columns), rows.sparkSession.sparkContext.defaultParallelism
    blocks = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(pack, "block binary")
    return blocks.repartition(tasks).rdd.map(lambda r: np.frombuffer(r[0]).reshape(count, -1)).persist(StorageLevel.MEMORY_AND_DISK)


class SearchFailed(Exception):
    """No step along a direction will do."""


class _Shape:
    """What the last ten steps say about the curvature: theta * I - W M W'."""

    def __init__(self, size: int, memory: int = 10):
        self.theta, self.w, self.m = 1.0, np.zeros((size, 2 * memory)), np.zeros((2 * memory, 2 * memory))
        self.memory, self.s, self.y = memory, [], []

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        if abs(s @ y) < 2.2e-16 * (y @ y):
            return
        self.s, self.y = [*self.s, s][-self.memory:], [*self.y, y][-self.memory:]
        steps, slopes = np.array(self.s).T, np.array(self.y).T
        self.theta = (y @ y) / (s @ y)
        self.w = np.hstack([slopes, steps * self.theta])
        a = steps.T @ slopes
        low = np.tril(a, -1)
        self.m = np.linalg.inv(np.block([[-np.diag(np.diag(a)), low.T], [low, (steps.T @ steps) * self.theta]]))

    def direction(self, x: np.ndarray, g: np.ndarray, low: np.ndarray, first: bool) -> np.ndarray:
        cauchy, c = self._cauchy(x, g, low)
        cauchy = np.maximum(cauchy, low)
        return (cauchy if first else np.maximum(self._subspace(cauchy, x, c, g, low), low)) - x

    def _cauchy(self, x, g, low):
        """The first minimum along the gradient, bent where it meets a bound."""
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(g > 0, (x - low) / g, np.inf)
        d = np.where((g == 0) | (t == 0), 0.0, -g)
        at, p, c = x.copy(), self.w.T @ d, np.zeros(len(self.m))
        slope = g @ d
        bend = -self.theta * slope - p @ (self.m @ p)
        step, gone = -(slope / bend), 0.0
        order = np.argsort(t, kind="stable")
        i = int(np.argmax(d[order] != 0))
        b = order[i]
        until = t[b]
        part = until
        while part <= step and i < len(x):
            at[b] = np.inf if d[b] > 0 else low[b]
            z, w = at[b] - x[b], self.w[b]
            c = c + p * part
            slope += part * bend + g[b] * g[b] + self.theta * g[b] * z - (w * g[b]) @ (self.m @ c)
            bend += -self.theta * g[b] * g[b] - 2 * g[b] * (w @ (self.m @ p)) - g[b] * g[b] * (w @ (self.m @ w))
            p = p + w * g[b]
            d[b] = 0.0
            step, gone, i = -slope / bend, until, i + 1
            if i < len(x):
                b = order[i]
                until = t[b]
                part = until - gone
        step = max(step, 0.0)
        free = t >= until
        at[free] = x[free] + (gone + step) * d[free]
        return at, c + p * step

    def _subspace(self, cauchy, x, c, g, low):
        """The minimum over the columns that are at no bound, cut where it would leave them."""
        free = cauchy != low
        wz = self.w[free].T
        rest = (g + (cauchy - x) * self.theta - self.w @ (self.m @ c))[free]
        v = np.linalg.solve(np.eye(len(self.m)) - self.m @ (wz @ wz.T / self.theta), self.m @ (wz @ rest))
        move = -(rest / self.theta + wz.T @ v / self.theta**2)
        back = move < 0
        share = min([1.0, *((low[free] - cauchy[free])[back] / move[back])])
        out = cauchy.copy()
        out[free] += move * share
        return out


Point = Generator[np.ndarray, tuple[float, np.ndarray], tuple]


def _between(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points and their slopes, away from both ends."""
    (lt, lf, ld), (rt, rf, rd) = (left, right) if left[0] <= right[0] else (right, left)
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    with np.errstate(invalid="ignore"):
        d2 = np.sqrt(np.float64(d1 * d1 - ld * rd))
        t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    return min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)) if t == t else t


def _step(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, low: np.ndarray) -> Point:
    """A step that meets the strong Wolfe conditions: the new point, its value and gradient."""
    slope = grad @ direction
    down = direction < 0
    bound = max(1.0, min([np.inf, *((low - x)[down] / direction[down])]))
    if slope > 0:
        raise SearchFailed(f"not a descent: {slope}")
    found = None

    def at(t: float):
        nonlocal found
        point = np.maximum(x + direction * t, low)
        v, g = yield point
        found = point, v, g
        return t, v, g @ direction

    def zoom(good: tuple, bad: tuple):
        for _ in range(64):
            t = _between(good, bad)
            if t != t:
                raise SearchFailed("no number between")
            c = yield from at(t)
            if c[1] > value + 1e-4 * t * slope or c[1] >= good[1]:
                bad = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return found
                if c[2] * (bad[0] - good[0]) >= 0:
                    bad = good
                good = c
        raise SearchFailed("zoom ended")

    t, last = 1.0, (0.0, value, slope)
    for i in range(64):
        c = yield from at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= last[1] and i > 0):
            return (yield from zoom(last, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return found
        if c[2] >= 0:
            return (yield from zoom(c, last))
        last = c
        if t == bound:
            return found
        t = min(t * 1.5, bound)
    raise SearchFailed("no end of the interval")


def minimised(x: np.ndarray, low: np.ndarray, steps: int = 50, tolerance: float = 1e-6) -> Point:
    """L-BFGS-B with lower bounds: yields points, is sent their value and gradient, returns the last point and all values."""
    value, grad = yield x
    shape, failed, values, recent = _Shape(len(x)), False, [value], [np.inf]
    while True:
        left = np.maximum(x - grad, low) - x
        if (
            np.abs(left).max() < 1e-5 or len(values) > steps or np.linalg.norm(grad) <= max(tolerance * value, 1e-8)
            or (len(recent) > 1 and abs(value - max(recent)) <= tolerance * abs(values[0]))
        ):
            return x, values
        try:
            direction = shape.direction(x, grad, low, len(values) == 1)
            new, new_value, new_grad = yield from _step(x, value, grad, direction, low)
        except SearchFailed:
            if failed:
                return x, values
            shape, failed = _Shape(len(x)), True
            continue
        shape.learn(new - x, new_grad - grad)
        x, value, grad, failed = new, new_value, new_grad, False
        values.append(value)
        recent = [*recent, value][-20:]


def side_by_side(searches: Sequence[Point], evaluate: Callable[[dict], dict]) -> list[tuple]:
    """Run searches by common evaluations: ``evaluate`` answers, for each unfinished search by number, the point asked."""
    asked, done = {i: next(s) for i, s in enumerate(searches)}, {}
    while asked:
        for i, answer in evaluate(asked).items():
            try:
                asked[i] = searches[i].send(answer)
            except StopIteration as end:
                done[i] = end.value
                del asked[i]
    return [done[i] for i in range(len(searches))]


@dataclass(frozen=True)
class Waves:
    """Cosines of ``shift + weights @ (x - mean) / scale``, for the rows before ``end``."""

    means: np.ndarray
    scales: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray  # of each wave, by column
    end: float

    def chunks(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Target, and waves above columns, a chunk of a block (lines: index, target, columns) at a time."""
        use = block[0] < self.end
        if not use.any():
            return
        block = block if use.all() else block[:, use]
        half = self.weights / self.scales / 2
        turn = (self.shifts / 2 - half @ self.means)[:, None]
        for start in range(0, block.shape[1], CHUNK):
            x = block[2:, start: start + CHUNK]
            out = np.empty((len(half) + len(x), x.shape[1]))
            waves = out[: len(half)]
            np.matmul(half, x, out=waves)
            waves += turn
            np.tan(waves, out=waves)  # cos a = 2 / (1 + tan(a / 2)**2) - 1, at a quarter of the time of cos
            np.square(waves, out=waves)
            waves += 1
            np.divide(2.0, waves, out=waves)
            waves -= 1
            out[len(half):] = x
            yield block[1, start: start + CHUNK], out


def _moments(blocks: Iterator[np.ndarray], fits: Sequence[Waves]) -> Iterator[list]:
    """Count, means and squared deviations of target, waves and columns of each fit."""
    out = [None] * len(fits)
    for block in blocks:
        for i, f in enumerate(fits):
            for y, x in f.chunks(block):
                values = np.vstack([y, x])
                mean = values.mean(1)
                out[i] = _joined(out[i], (len(y), mean, np.square(values - mean[:, None]).sum(1)))
    yield out


def _joined(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)


def _loss_sums(blocks: Iterator[np.ndarray], asked: Sequence[tuple], epsilon: float) -> Iterator[list]:
    """Loss, slope by the scale and slopes by the intercept and the columns, added up, of each fit asked."""
    out = [0.0] * len(asked)
    for block in blocks:
        for i, (waves, slopes, intercept, scale) in enumerate(asked):
            for y, x in waves.chunks(block):
                away = y - slopes @ x - intercept
                size, limit = np.abs(away), scale * epsilon
                inner = size <= limit
                ratio = np.where(inner, away, 0.0) / scale
                pull = np.where(inner, -ratio, -epsilon * np.sign(away))
                outer = len(y) - np.count_nonzero(inner)
                square = ratio @ ratio
                loss = 0.5 * (scale * len(y) + scale * square + 2 * epsilon * size[~inner].sum() - outer * scale * epsilon**2)
                by_scale = 0.5 * (len(y) - square - outer * epsilon**2)
                out[i] = out[i] + np.concatenate([[loss, by_scale, pull.sum()], x @ pull])
    yield out


@dataclass(frozen=True)
class Line:
    """A fitted line over waves and columns."""

    slopes: np.ndarray
    intercept: float
    scale: float
    values: list  # of the objective, step by step


def fit_lines(blocks: RDD, fits: Sequence[Waves], penalties: Sequence[float], epsilon: float = 1.35) -> list[Line | None]:
    """The line of each fit; none where the target does not vary."""
    def gathered(run, *args):
        return blocks.mapPartitions(lambda part: run(part, *args)).collect()

    moments: list = [None] * len(fits)
    for part in gathered(_moments, fits):
        moments = [_joined(a, b) for a, b in zip(moments, part)]
    usable = [i for i, m in enumerate(moments) if m is not None and m[0] > 1 and m[2][0] > 0]
    inverse, centre = {}, {}
    for i in usable:
        deviation = np.sqrt(moments[i][2][1:] / (moments[i][0] - 1))
        inverse[i] = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
        centre[i] = moments[i][1][1:] * inverse[i]

    def raw(i: int, point: np.ndarray) -> tuple:
        """Slopes and intercept for columns as they are, from those for standardised ones."""
        return point[:-2] * inverse[i], point[-2] - point[:-2] @ centre[i]

    def evaluate(asked: dict) -> dict:
        numbers = list(asked)
        sums = gathered(_loss_sums, [(fits[usable[k]], *raw(usable[k], asked[k]), asked[k][-1]) for k in numbers], epsilon)
        out = {}
        for k, total in zip(numbers, (sum(s) for s in zip(*sums))):
            i, slopes, n = usable[k], asked[k][:-2], moments[usable[k]][0]
            by_slope = (total[3:] * inverse[i] - total[2] * centre[i]) / n + penalties[i] * slopes
            out[k] = total[0] / n + 0.5 * penalties[i] * (slopes @ slopes), np.concatenate([by_slope, [total[2] / n, total[1] / n]])
        return out

    searches = []
    for i in usable:
        start = np.ones(len(centre[i]) + 2)
        start[-2] += centre[i].sum()
        searches.append(minimised(start, np.concatenate([np.full(len(start) - 1, -np.inf), [TINY]])))
    lines: list[Line | None] = [None] * len(fits)
    for i, (point, values) in zip(usable, side_by_side(searches, evaluate)):
        lines[i] = Line(*raw(i, point), point[-1], values)
    return lines
