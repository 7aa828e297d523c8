"""Repeatable randomness from row keys.

``rand(seed)`` depends on how rows are partitioned.  A hash of the row's key
does not, so reruns and other cluster sizes give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _word(digest: Column, i: int) -> Column:
    number = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double")
    return (number + 0.5) / F.lit(4294967296.0)


def add_standard_normals(df: DataFrame, key: Column, seed: str, names: Sequence[str]) -> DataFrame:
    """Add independent standard normal columns; one digest serves four of them."""
    digests = {
        f"_digest_{b}": F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}{b}"))) for b in range((len(names) + 3) // 4)
    }
    normals: list[Column] = []
    for digest in digests:
        for pair in (0, 2):
            radius = F.sqrt(F.lit(-2.0) * F.ln(_word(F.col(digest), pair)))
            angle = F.lit(2 * pi) * _word(F.col(digest), pair + 1)
            normals += [radius * F.cos(angle), radius * F.sin(angle)]
    return df.withColumns(digests).withColumns(dict(zip(names, normals))).drop(*digests)
