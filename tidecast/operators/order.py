"""Row order at scale: dense positions and windows that split long series.

An unpartitioned window sends a whole series to one task.  Here a series gets
a dense position by a range sort, and windows run over fixed-size stretches of
positions.  Each stretch carries a halo of its neighbours' rows, as wide as the
longest look-back, so every row sees what it would see in one global window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidecast.storage import written_table

STRETCH = 16_384
_POSITION_BITS = 33


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, so rows of an unnamed series are kept."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_of_{k}" for k in keys])


def dense_index(
    df: DataFrame,
    order_cols: Sequence[str],
    series_cols: Sequence[str] = (),
    name: str = "t_idx",
) -> DataFrame:
    """Add a 0-based position within each series, ordered by ``order_cols``.

    ``order_cols`` must end in a tie-breaker.  The range sort spreads even one
    series, or one repeated timestamp, over all partitions.  The sorted rows
    are written once, so the counts and the positions come from the same sort.
    """
    keys = [*series_cols, *order_cols]
    place = F.monotonically_increasing_id()
    stored = written_table(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place),
        "indexed",
    )
    part = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per sort partition, whatever the number of data rows.
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    placed = (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position)
        .drop("_part", "_offset", "_place")
    )
    if not series_cols:
        return placed
    starts = placed.groupBy(*series_cols).agg(F.min(name).alias("_start"))
    joined = join_keys(placed, starts, series_cols)
    return joined.select(*df.columns, (F.col(name) - F.col("_start")).alias(name))


def without_nulls(df: DataFrame, col: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``col`` is neither null nor NaN, at dense positions; ``_was`` is the position before."""
    missing = F.col(col).isNull() | F.col(col).cast("double").eqNullSafe(F.lit(float("nan")))
    rows = df.where(~missing).withColumn("_was", F.col("t_idx"))
    if not df.where(missing).limit(1).count():
        return rows
    return dense_index(rows.drop("t_idx"), ["_was"], series_cols)


def stretch_of(index: str, size: int) -> Column:
    """Number of the stretch a position falls in."""
    return F.expr(f"`{index}` div {size}L")


def with_halo(df: DataFrame, size: int, behind: int, ahead: int = 0, index: str = "t_idx") -> DataFrame:
    """Each row in its stretch, ``_stretch``, and in the neighbours' that look at it."""
    home = stretch_of(index, size)
    offset = F.pmod(F.col(index), F.lit(size))
    places = [home]
    if behind:
        places.append(F.when(offset >= size - behind, home + 1))
    if ahead:
        places.append(F.when((offset < ahead) & (home > 0), home - 1))
    return df.withColumn("_stretch", F.explode(F.array_compact(F.array(*places))))


def over_order(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    behind: int,
    ahead: int = 0,
    series_cols: Sequence[str] = (),
    index: str = "t_idx",
    stretch: int | None = None,
) -> DataFrame:
    """Add window columns that look at most ``behind`` rows back and ``ahead`` on.

    ``build`` gets the window and returns the new columns.  No task holds more
    than one stretch plus its halo, however long a series is.
    """
    size = max(stretch or STRETCH, 10 * max(behind, ahead, 1))
    home = stretch_of(index, size)
    spread = with_halo(df, size, behind, ahead, index)
    window = Window.partitionBy(*series_cols, "_stretch").orderBy(index)
    built = build(window)
    return (
        spread.select(*spread.columns, *[c.alias(n) for n, c in built.items()])
        .where(F.col("_stretch") == home)
        .drop("_stretch")
    )


def last_known(
    df: DataFrame,
    col: str,
    out: str,
    series_cols: Sequence[str] = (),
    index: str = "t_idx",
    stretch: int = STRETCH,
) -> DataFrame:
    """Latest non-null ``col`` at or before each row, with no limit on how far back.

    Each stretch is filled on its own.  Its opening value comes from the
    stretches before it, which are filled the same way, so the number of rows
    per task shrinks by the stretch size at every level.
    """
    keys = list(series_cols)
    last = df.agg(F.max(index)).first()[0] or 0

    def fill(rows: DataFrame, value: str, result: str, at: str, top: int) -> DataFrame:
        home = f"_{at}_home"
        placed = rows.withColumn(home, stretch_of(at, stretch))
        inside = Window.partitionBy(*keys, home).orderBy(at)
        filled = placed.withColumn(result, F.last(value, ignorenulls=True).over(inside))
        if top < stretch:
            return filled.drop(home)
        # Every stretch needs an opening value, also one without a known value.
        ends = placed.groupBy(*keys, home).agg(
            F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("_end")
        )
        carried = fill(ends, "_end", "_carried", home, top // stretch)
        opening = carried.select(
            *keys, (F.col(home) + 1).alias(home), F.col("_carried").alias(f"{home}_open")
        )
        return (
            join_keys(filled, opening, [*keys, home], "left")
            .withColumn(result, F.coalesce(result, f"{home}_open"))
            .drop(home, f"{home}_open")
        )

    return fill(df, col, out, index, last)
