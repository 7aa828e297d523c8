"""Holt and Holt-Winters smoothing of series of any length.

The smoothing state is a linear recurrence.  A stretch of rows therefore acts
on its opening state as one matrix and one offset, so stretches are worked on
side by side: first their offsets, then the opening states (the same problem on
a table shorter by the stretch size), then the forecasts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.order import stretch_of, join_keys, without_nulls
from tidecast.storage import written_table

STRETCH = 4096    # rows solved as one, and rows of short stretches that one call works on
CHUNK = 64        # rows solved by one set of products
WHOLE_STATE = 66  # numbers of a state up to which its matrix is raised to powers


@dataclass(frozen=True)
class Smoothing:
    """Weights for level, trend and season; ``period`` 0 means no season.

    The trend weight acts on changes of the level, the seasonal one on what the
    level does not explain.
    """

    alpha: float
    beta: float
    gamma: float = 0.0
    period: int = 0

    @property
    def size(self) -> int:
        return 2 + self.period

    def matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State step, input weights and forecast weights."""
        n = self.size
        ahead = np.zeros(n)
        ahead[:2] = 1.0
        if self.period:
            ahead[2] = 1.0
        step = np.zeros((n, n))
        step[0, :2] = 1.0
        step[1, 1] = 1.0
        gain = np.zeros(n)
        gain[0], gain[1] = self.alpha, self.alpha * self.beta
        if self.period:
            for i in range(self.period - 1):
                step[2 + i, 3 + i] = 1.0
            step[n - 1, 2] = 1.0
            gain[n - 1] = self.gamma * (1 - self.alpha)
        return step - np.outer(gain, ahead), gain, ahead

    def opening(self, first: np.ndarray) -> np.ndarray:
        """State before the first row, from the first two seasons (or two values)."""
        state = np.zeros(self.size)
        m = max(self.period, 1)
        state[0] = first[:m].mean()
        if len(first) >= 2 * m:
            state[1] = (first[m:2 * m].mean() - state[0]) / m
        if self.period:
            season = first[:m] - state[0]
            state[2:2 + len(season)] = season
        state[0] -= state[1]
        return state


class Scan:
    """Runs all options over rows, a chunk at a time.

    Inside a chunk no season is used twice, so level and trend follow a linear
    recurrence of two numbers with known inputs, and the powers of its matrix
    give a chunk in a few products.  The seasons are a ring that the chunk's
    errors are added to.  For p options this holds p * (period + rows + CHUNK**2)
    numbers: with a period of 1,008, 24 options and a stretch of 4,096 rows some
    2 MB; matrices of the whole state are made for short seasons only.
    """

    def __init__(self, options: Sequence[Smoothing]):
        self.options, self.period, self.size = options, options[0].period, options[0].size
        self.chunk = min(CHUNK, self.period) if self.period else CHUNK
        gain = np.array([[o.alpha, o.alpha * o.beta] for o in options])
        step = np.array([[1.0, 1.0], [0.0, 1.0]]) - gain[:, :, None] * np.ones(2)
        self.season_gain = np.array([o.gamma * (1 - o.alpha) for o in options])[:, None]
        self.powers = np.empty((self.chunk + 1, len(options), 2, 2))
        self.powers[0] = np.eye(2)
        for k in range(self.chunk):
            self.powers[k + 1] = step @ self.powers[k]
        moved = np.einsum("kpij,pj->pki", self.powers, gain)  # what an input is worth k rows after its row
        self.ends = moved[:, self.chunk - 1:: -1][:, : self.chunk]
        lag = np.arange(self.chunk)[:, None] - 1 - np.arange(self.chunk)
        self.answers = np.where(lag >= 0, moved.sum(2)[:, np.maximum(lag, 0)], 0.0)
        self.ahead = self.powers.sum(2).transpose(1, 0, 2)  # level and trend, k rows on, as a forecast

    def run(self, y: np.ndarray | None, state: np.ndarray, rows: int | None = None) -> tuple[np.ndarray | None, np.ndarray]:
        """Forecasts (rows, options) and the state after; without ``y`` only the state after ``rows`` zeros."""
        rows = len(y) if y is not None else rows
        line, ring = state[:, :2].copy(), state[:, 2:].copy()
        out = np.empty((rows, len(self.options))) if y is not None else None
        for lo in range(0, rows, self.chunk):
            c = min(self.chunk, rows - lo)
            values = y[lo: lo + c] if y is not None else 0.0
            if self.period:
                at = np.arange(lo, lo + c) % self.period
                u = values - ring[:, at]
            else:
                u = np.broadcast_to(values, (len(line), c))
            guess = np.einsum("pki,pi->pk", self.ahead[:, :c], line) + (self.answers[:, :c, :c] @ u[:, :, None])[:, :, 0]
            if out is not None:
                out[lo: lo + c] = (guess + ring[:, at] if self.period else guess).T
            if self.period:
                ring[:, at] += self.season_gain * (u - guess)
            line = np.einsum("pij,pj->pi", self.powers[c], line) + np.einsum("pki,pk->pi", self.ends[:, self.chunk - c:], u)
        return out, np.concatenate([line, np.roll(ring, -rows % self.period if self.period else 0, axis=1)], axis=1)

    def over(self, rows: int) -> Callable[[np.ndarray], np.ndarray]:
        """What ``rows`` rows make of a state if all values are 0."""
        if self.size > WHOLE_STATE:
            return lambda state: self.run(None, state, rows)[1]
        power = np.stack([np.linalg.matrix_power(o.matrices()[0], rows) for o in self.options])
        return lambda state: np.einsum("pij,pj->pi", power, state)


def _chained(carry: Callable[[np.ndarray], np.ndarray], offsets: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States before each stretch and after the last."""
    out = np.empty((len(offsets) + 1, *state.shape))
    out[0] = state
    for i, offset in enumerate(offsets):
        out[i + 1] = carry(out[i]) + offset
    return out


def _opening_states(
    offsets: DataFrame, starts: DataFrame, scan: Scan, unit: int, key_schema: list[str], keys: list[str],
    top: int, stretch: int,
) -> DataFrame:
    """State before each stretch, from offsets ``(keys, at, offset)`` in order of ``at``; one ``at`` is ``unit`` rows."""
    shape = (len(scan.options), scan.size)
    schema = ", ".join([*key_schema, "at bigint", "opening array<double>"])

    def chain(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        inputs = np.stack(pdf["offset"].to_list()).reshape(-1, *shape)
        states = _chained(scan.over(unit), inputs, np.array(start["opening"].iloc[0]).reshape(shape))
        return pdf[[*keys, "at"]].assign(opening=[s.ravel().tolist() for s in states[:-1]])

    if top < stretch:
        return offsets.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(chain, schema)
    placed = offsets.withColumn("home", stretch_of("at", stretch))

    def squeeze(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        inputs = np.stack(pdf["offset"].to_list()).reshape(-1, *shape)
        end = _chained(scan.over(unit), inputs, np.zeros(shape))[-1]
        first = pdf.iloc[0]
        row = [*[first[k] for k in keys], first["home"], end.ravel().tolist()]
        return pd.DataFrame([row], columns=[*keys, "at", "offset"])

    groups = [*keys, "home"]
    squeezed = written_table(placed.groupBy(*groups).applyInPandas(
        squeeze, ", ".join([*key_schema, "at bigint", "offset array<double>"])
    ), "offsets")
    upper = _opening_states(squeezed, starts, scan, unit * stretch, key_schema, keys, top // stretch, stretch)
    above = upper.withColumnRenamed("at", "home")
    return placed.groupBy(*groups).cogroup(above.groupBy(*groups)).applyInPandas(chain, schema)


def smooth(
    df: DataFrame,
    options: Sequence[Smoothing],
    col: str = "y",
    series_cols: Sequence[str] = (),
    stretch: int = STRETCH,
) -> DataFrame:
    """One-step forecasts of every row by the option with the least squared error.

    All options share one period.  With several options the error counts rows
    where ``is_train`` is true, if the column exists.
    """
    keys = list(series_cols) or ["_all"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields} | {"_all": "int"}
    key_schema = [f"`{k}` {types[k]}" for k in keys]
    scan = Scan(options)
    shape = (len(options), scan.size)
    head = 2 * max(options[0].period, 1)
    many = max(1, STRETCH // stretch)  # stretches of a call
    flag = F.col("is_train") if "is_train" in df.columns else F.lit(True)
    rows = without_nulls(df, col, series_cols).withColumn("_all", F.lit(0)).select(
        *keys, "t_idx", "_was", F.col(col).cast("double").alias("y"), flag.alias("is_train"),
        stretch_of("t_idx", stretch).alias("at"), stretch_of("t_idx", stretch * many).alias("call"),
    )
    groups = [*keys, "call"]

    def stretches(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of the stretches of sorted rows, and the values of each."""
        at, first = np.unique(pdf["at"].to_numpy(), return_index=True)
        return at, np.split(pdf["y"].to_numpy(), first[1:])

    def offsets_of(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        at, values = stretches(pdf.sort_values("t_idx"))
        ends = [scan.run(y, np.zeros(shape))[1].ravel().tolist() for y in values]
        return pd.DataFrame([[*[first[k] for k in keys], a, e] for a, e in zip(at, ends)], columns=[*keys, "at", "offset"])

    def opening_of(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t_idx")["y"].to_numpy()
        state = np.stack([o.opening(y) for o in options]).ravel().tolist()
        first = pdf.iloc[0]
        return pd.DataFrame([[*[first[k] for k in keys], state]], columns=[*keys, "opening"])

    top = rows.agg(F.max("at")).first()[0] or 0
    offsets = written_table(rows.groupBy(*groups).applyInPandas(
        offsets_of, ", ".join([*key_schema, "at bigint", "offset array<double>"])
    ), "offsets")
    # Two seasons per series at most.
    heads = rows.where(F.col("t_idx") < head).groupBy(*keys).applyInPandas(
        opening_of, ", ".join([*key_schema, "opening array<double>"])
    )
    openings = written_table(_opening_states(offsets, heads, scan, stretch, key_schema, keys, top, stretch), "openings")

    def forecasts(pdf: pd.DataFrame, opening: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("t_idx")
        states = dict(zip(opening["at"], opening["opening"]))
        return pdf, np.concatenate([scan.run(y, np.array(states[a]).reshape(shape))[0] for a, y in zip(*stretches(pdf))])

    def errors(pdf: pd.DataFrame, opening: pd.DataFrame) -> pd.DataFrame:
        pdf, f = forecasts(pdf, opening)
        used = pdf["is_train"].to_numpy()
        sse = ((pdf["y"].to_numpy()[:, None] - f) ** 2)[used].sum(axis=0)
        own = [pdf.iloc[0][k] for k in keys]
        return pd.DataFrame(
            [[*own, i, float(s)] for i, s in enumerate(sse)], columns=[*keys, "option", "sse"]
        )

    openings = openings.withColumn("call", stretch_of("at", many))
    if len(options) > 1:
        scored = rows.groupBy(*groups).cogroup(openings.groupBy(*groups)).applyInPandas(
            errors, ", ".join([*key_schema, "option int", "sse double"])
        )
        total = scored.groupBy(*keys, "option").agg(F.sum("sse").alias("sse"))
        best = total.groupBy(*keys).agg(F.min_by("option", F.struct("sse", "option")).alias("option"))
        openings = join_keys(openings, best, keys)
    else:
        openings = openings.withColumn("option", F.lit(0))

    def predict(pdf: pd.DataFrame, opening: pd.DataFrame) -> pd.DataFrame:
        pdf, f = forecasts(pdf, opening)
        option = int(opening["option"].iloc[0])
        pdf = pdf.assign(prediction=f[:, option], option=option)
        return pdf[[*keys, "_was", "y", "is_train", "option", "prediction"]].rename(columns={"_was": "t_idx"})

    out = rows.groupBy(*groups).cogroup(openings.groupBy(*groups)).applyInPandas(
        predict,
        ", ".join([*key_schema, "t_idx bigint", "y double", "is_train boolean", "option int", "prediction double"]),
    )
    return out.drop("_all")


def weight_grid(period: int = 0) -> list[Smoothing]:
    """A coarse grid of weights."""
    levels, trends = (0.1, 0.3, 0.6, 0.9), (0.0, 0.1, 0.3)
    seasons = (0.1, 0.3) if period else (0.0,)
    return [Smoothing(a, b, g, period) for a in levels for b in trends for g in seasons]
