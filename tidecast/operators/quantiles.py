"""Exact quantiles without gathering a column in one place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, floor, inf, nan, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
RANKED_AT_ONCE = 100_000
_GRID = [i / 250 for i in range(251)]


@dataclass
class _Gap:
    """An open value range between two cuts of one column, with the ranks sought in it."""

    col: int
    lo: float
    hi: float
    below: int
    rows: int
    ranks: list[int] = field(default_factory=list)


def place_codes(df: DataFrame, cuts: dict[str, Sequence[float]], prefix: str = "_code_") -> DataFrame:
    """Add where each value lies among sorted cuts, found by binary search.

    Even codes are the ranges between cuts, odd codes the cuts themselves:
    0 is below the first cut, 1 on it, 2 above it, and so on.
    """
    splits = []
    for values in cuts.values():
        edges = [-inf]
        for c in sorted(set(values)):
            edges += [c, nextafter(c, inf)]
        splits.append([*edges, inf] if len(edges) > 1 else [-inf, 0.0, inf])
    finder = Bucketizer(
        inputCols=list(cuts), outputCols=[f"{prefix}{c}" for c in cuts], splitsArray=splits, handleInvalid="keep"
    )
    return finder.transform(df)


def _long(df: DataFrame, cols: Sequence[str], gaps: Sequence[_Gap]) -> DataFrame:
    """``(col, code, value)`` of every non-null value, coded by the gaps' bounds."""
    bounds = {c: [] for c in cols}
    for g in gaps:
        bounds[cols[g.col]] += [b for b in (g.lo, g.hi) if abs(b) != inf]
    held = [c for c in cols if bounds[c]]
    coded = place_codes(df, {c: bounds[c] for c in held}) if held else df
    return coded.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("col"),
            (F.col(f"_code_{c}").cast("int") if c in held else F.lit(0)).alias("code"),
            F.col(c).alias("value"),
        )
        for i, c in enumerate(cols)
    ]))).where("value is not null")


def _codes(cols: Sequence[str], gaps: Sequence[_Gap]) -> dict[tuple[int, int], _Gap]:
    """The gap behind each (column, code)."""
    out = {}
    for i in range(len(cols)):
        mine = [g for g in gaps if g.col == i]
        cuts = sorted({b for g in mine for b in (g.lo, g.hi) if abs(b) != inf})
        for g in mine:
            out[(i, 0 if g.lo == -inf else 2 * (cuts.index(g.lo) + 1))] = g
    return out


def _chosen(keys: Sequence[tuple[int, int]], values: Sequence, default) -> Column:
    """Value for the row's (col, code), as a lookup in a literal map."""
    entries = [x for (c, k), v in zip(keys, values) for x in (F.lit(c * 100_000 + k), v)]
    found = F.try_element_at(F.create_map(*entries), F.col("col") * 100_000 + F.col("code"))
    return F.coalesce(found, default) if default is not None else found


def _narrow(df: DataFrame, cols: Sequence[str], gaps: list[_Gap], points: Sequence[float], found: dict) -> list[_Gap]:
    """Split gaps at sketched values; exact counts place every rank."""
    at = _codes(cols, gaps)
    inside = _chosen(list(at), [F.lit(True)] * len(at), F.lit(False))
    sketch = F.percentile_approx("value", list(points), SKETCH_ACCURACY).alias("cuts")
    sketched = _long(df, cols, gaps).where(inside).groupBy("col", "code").agg(sketch)
    cuts: dict[int, set[float]] = {i: set() for i in range(len(cols))}
    for row in sketched.collect():
        g = at[(row["col"], row["code"])]
        for r in g.ranks:
            share = (r - g.below) / max(g.rows - 1, 1)
            slack = 2.0 / SKETCH_ACCURACY
            before = [v for p, v in zip(points, row["cuts"]) if p <= share - slack]
            after = [v for p, v in zip(points, row["cuts"]) if p >= share + slack]
            cuts[g.col] |= {v for v in (before[-1:] + after[:1])}
    named = {cols[i]: sorted(cuts[i] | {b for g in gaps if g.col == i for b in (g.lo, g.hi) if abs(b) != inf})
             for i in range(len(cols)) if cuts[i]}
    coded = place_codes(df, named).select(F.inline(F.array(*[
        F.struct(F.lit(cols.index(c)).alias("col"), F.col(f"_code_{c}").cast("int").alias("code")) for c in named
    ]))).where("code is not null")
    tally = {(row["col"], row["code"]): row["n"] for row in coded.groupBy("col", "code").agg(F.count("*").alias("n")).collect()}
    left = []
    for name, values in named.items():
        i = cols.index(name)
        ranks = sorted(r for g in gaps if g.col == i for r in g.ranks)
        below = 0
        for code in range(2 * len(values) + 1):
            n = tally.get((i, code), 0)
            here = [r for r in ranks if below <= r < below + n]
            if here and code % 2:
                found.update({(i, r): values[code // 2] for r in here})
            elif here:
                lo = values[code // 2 - 1] if code else -inf
                hi = values[code // 2] if code // 2 < len(values) else inf
                left.append(_Gap(i, lo, hi, below, n, here))
            below += n
    return left


def _rank(df: DataFrame, cols: Sequence[str], gaps: list[_Gap], found: dict) -> None:
    """Look up the sought ranks in gaps of at most RANKED_AT_ONCE rows each."""
    at = _codes(cols, gaps)
    keys, slots = list(at), list(at.values())
    slot = _chosen(keys, [F.lit(i) for i in range(len(keys))], None)
    held = (
        _long(df, cols, gaps).withColumn("slot", slot).where("slot is not null")
        .groupBy("slot", "value").agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value"))
    aims = F.array(*[F.array(*[F.lit(r - g.below).cast("bigint") for r in g.ranks]) for g in slots])
    hits = (
        held.withColumn("upto", upto)
        .withColumn("rank", F.explode(F.element_at(aims, F.col("slot") + 1)))
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .select("slot", "rank", "value")
    )
    for row in hits.collect():
        g = slots[row["slot"]]
        found[(g.col, row["rank"] + g.below)] = row["value"]


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, nulls and NaN left out.

    Sketches only propose where to cut; exact counts decide.  Every pass leaves
    a small part of the rows in question until they are few enough to rank, so
    no task sees more than RANKED_AT_ONCE of them.  The result has one number
    per column and probability.
    """
    cols = list(dict.fromkeys(cols))
    df = df.select(*[F.nullif(F.col(c).cast("double"), F.lit(nan)).alias(c) for c in cols])
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    found: dict[tuple[int, int], float] = {}
    gaps = []
    for i, c in enumerate(cols):
        ranks = sorted({f(p * (n[c] - 1)) for p in probs for f in (floor, ceil)}) if n[c] else []
        if ranks:
            gaps.append(_Gap(i, -inf, inf, 0, n[c], ranks))
    slack = 3.0 / SKETCH_ACCURACY
    points = sorted({min(max(p + s, 0.0), 1.0) for p in probs for s in (-slack, slack)} | {0.0, 1.0})
    while wide := [g for g in gaps if g.rows > RANKED_AT_ONCE]:
        gaps = [g for g in gaps if g.rows <= RANKED_AT_ONCE] + _narrow(df, cols, wide, points, found)
        points = _GRID
    if gaps:
        _rank(df, cols, gaps, found)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            if not n[c]:
                out[c].append(None)
                continue
            spot = p * (n[c] - 1)
            lo, hi = found[(i, floor(spot))], found[(i, ceil(spot))]
            out[c].append(lo + (hi - lo) * (spot - floor(spot)))
    return out
