"""Column names: normalising them and grouping features by what they say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised_names(names: list[str]) -> list[str]:
    """Lower-case snake names; a name already taken gets ``_2``, ``_3`` and so on."""
    taken: dict[str, int] = {}
    out = []
    for name in names:
        plain = "_".join(word for word in re.split("[ _]+", name.lower().strip()) if word)
        taken[plain] = taken.get(plain, 0) + 1
        out.append(plain if taken[plain] == 1 else f"{plain}_{taken[plain]}")
    return out


def rename_normalised(df: DataFrame) -> DataFrame:
    """Normalise all column names; the original name stays in the field metadata."""
    fresh = normalised_names(df.columns)
    renamed = df.toDF(*fresh)
    return renamed.select(*[
        F.col(new).alias(new, metadata={"original_name": old})
        for old, new in zip(df.columns, fresh)
    ])


# The words that put a feature name into a group.
TIME_WORDS = ["time", "date", "year", "month", "day", "hour", "dow"]
LAG_WORDS = ["lag"]
ROLLING_WORDS = ["rolling", "mean", "std"]


def _mentions(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def feature_groups(names: DataFrame, name_col: str = "feature") -> DataFrame:
    """Size of the time, lag, rolling and other groups.

    A name can be in several of the first three groups; ``other`` is the rest.
    """
    name = F.col(name_col)
    flags = {
        "time": _mentions(name, TIME_WORDS),
        "lag": _mentions(name, LAG_WORDS),
        "rolling": _mentions(name, ROLLING_WORDS),
    }
    other = ~(flags["time"] | flags["lag"] | flags["rolling"])
    sizes = names.agg(*[F.count_if(c).alias(g) for g, c in {**flags, "other": other}.items()])
    return long_form(sizes, {g: {"features": g} for g in [*flags, "other"]}, "feature_group")


def long_form(wide: DataFrame, rows: dict[str, dict[str, str]], key: str = "column",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Turn one wide aggregate row into one row per entry of ``rows``.

    ``rows`` maps an entry name to {output column: wide column}.
    """
    entries = F.array(*[
        F.struct(F.lit(name).alias(key), *[F.col(src).alias(out) for out, src in cols.items()])
        for name, cols in rows.items()
    ])
    return wide.select(*keep, F.inline(entries))
