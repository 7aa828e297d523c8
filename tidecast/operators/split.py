"""Chronological holdout and expanding-window folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.order import join_keys

HOLDOUT_SHARE = 0.2
FOLDS = 5


def resolve_split_mode(mode: str, has_order: bool = True) -> str:
    """``auto`` means ``time_series``; random splits are refused."""
    if mode == "random":
        raise ValueError("random splits are forbidden: they mix future rows into training")
    if mode not in ("auto", "time_series"):
        raise ValueError(f"unknown split mode {mode}")
    if not has_order:
        raise ValueError("no time column found: name an order column")
    return "time_series"


def chronological(
    df: DataFrame, series_cols: Sequence[str] = (), index: str = "t_idx"
) -> tuple[DataFrame, DataFrame]:
    """Train and holdout: the last fifth of every series is held out."""
    if not series_cols:
        n = (df.agg(F.max(index)).first()[0] or 0) + 1
        first = floor((1 - HOLDOUT_SHARE) * n)
        return df.where(F.col(index) < first), df.where(F.col(index) >= first)
    keys = list(series_cols)
    starts = df.groupBy(*keys).agg(
        F.floor((1 - HOLDOUT_SHARE) * (F.max(index) + 1)).alias("_first")
    )
    marked = join_keys(df, starts, keys)
    train = marked.where(F.col(index) < F.col("_first")).drop("_first")
    return train, marked.where(F.col(index) >= F.col("_first")).drop("_first")


@dataclass(frozen=True)
class Fold:
    fold: int
    train_end: int
    test_start: int
    test_end: int

    def train(self, index: str = "t_idx") -> Column:
        return F.col(index) < self.train_end

    def test(self, index: str = "t_idx") -> Column:
        return (F.col(index) >= self.test_start) & (F.col(index) < self.test_end)


def expanding_folds(n: int, folds: int = FOLDS) -> list[Fold]:
    """Folds over ``n`` training rows, with a gap of one fold width before each test part."""
    width = n // (folds + 2)
    if width < 1:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    starts = [n - (folds - i) * width for i in range(folds)]
    return [Fold(i, s - width, s, s + width) for i, s in enumerate(starts)]


def panel_folds(df: DataFrame, series_cols: Sequence[str], folds: int = FOLDS, index: str = "t_idx") -> DataFrame:
    """``fold, train_end, test_start, test_end`` of every series, by its own length; too short series have none."""
    keys = list(series_cols)
    n = df.groupBy(*keys).agg(F.floor((1 - HOLDOUT_SHARE) * (F.max(index) + 1)).alias("_n")).withColumn(
        "_width", F.expr(f"_n div {folds + 2}")).where("_width > 0")
    start = F.col("_n") - (folds - F.col("fold")) * F.col("_width")
    return n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select(
        *keys, "fold", (start - F.col("_width")).alias("train_end"), start.alias("test_start"), (start + F.col("_width")).alias("test_end"))


def panel_fold_roles(df: DataFrame, series_cols: Sequence[str], folds: int = FOLDS, index: str = "t_idx") -> DataFrame:
    """Like ``fold_roles``, every series by its own folds; bounds meet the rows as one array a series."""
    keys = list(series_cols)
    bounds = panel_folds(df, keys, folds, index).groupBy(*keys).agg(
        F.collect_list(F.struct("fold", "train_end", "test_start", "test_end")).alias("_folds"))
    role = lambda f: F.when(F.col(index) < f["train_end"], "train").when(
        (F.col(index) >= f["test_start"]) & (F.col(index) < f["test_end"]), "test")
    roles = F.transform("_folds", lambda f: F.struct(f["fold"].alias("fold"), role(f).alias("role")))
    return join_keys(df, bounds, keys).select(*df.columns, F.inline(F.filter(roles, lambda x: x["role"].isNotNull())))


def fold_roles(df: DataFrame, folds: Sequence[Fold], index: str = "t_idx") -> DataFrame:
    """Each row once per fold and role it plays."""
    roles = [
        F.when(cond, F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role")))
        for f in folds
        for role, cond in (("train", f.train(index)), ("test", f.test(index)))
    ]
    return df.select("*", F.inline(F.array_compact(F.array(*roles))))


def test_folds(
    df: DataFrame, series_cols: Sequence[str] = (), folds: int = FOLDS, index: str = "t_idx"
) -> DataFrame:
    """Mark each row with the fold it is tested in and whether it is held out.

    Series lengths are joined by key; rows before the first fold have no fold.
    """
    keys = list(series_cols)
    n_train = F.floor((1 - HOLDOUT_SHARE) * (F.max(index) + 1))
    if keys:
        marked = join_keys(df, df.groupBy(*keys).agg(n_train.alias("_n")), keys)
    else:
        marked = df.withColumn("_n", F.lit(df.agg(n_train).first()[0]))
    width = F.expr(f"_n div {folds + 2}")
    number = F.floor((F.col(index) - (F.col("_n") - folds * width)) / F.nullif(width, F.lit(0)))
    tested = (number >= 0) & (F.col(index) < F.col("_n"))
    return marked.withColumns({
        "fold": F.when(tested, number).cast("int"), "is_holdout": F.col(index) >= F.col("_n"),
    }).drop("_n")
