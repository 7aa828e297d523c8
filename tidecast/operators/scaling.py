"""Scalers as pipeline stages, so they are fitted on the training part only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_stages(scaler: str | None, cols: Sequence[str], out: str | None = None) -> list[Estimator | Transformer]:
    """Assemble ``cols`` and scale them; without a scaler they are only assembled."""
    raw = f"_raw_{scaler}"
    final = out or f"_scaled_{scaler}"
    if scaler is None or not cols:
        return [VectorAssembler(inputCols=list(cols), outputCol=final)]
    kinds = {
        "StandardScaler": lambda: StandardScaler(inputCol=raw, outputCol=final, withMean=True, withStd=True),
        "MinMaxScaler": lambda: MinMaxScaler(inputCol=raw, outputCol=final),
    }
    return [VectorAssembler(inputCols=list(cols), outputCol=raw), kinds[scaler]()]


def spread(df: DataFrame, scaled: dict[str, Sequence[str]]) -> DataFrame:
    """Scaled vectors back to one column per feature."""
    for scaler, cols in scaled.items():
        values = vector_to_array(f"_scaled_{scaler}")
        df = df.withColumns({f"{c}_scaled": F.get(values, i) for i, c in enumerate(cols)})
    return df.drop(*[p + s for s in scaled for p in ("_raw_", "_scaled_")])
