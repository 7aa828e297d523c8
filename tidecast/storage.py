"""Where intermediate tables live.

Everything that cuts lineage is a written table in the shared folder named by
``spark.checkpoint.dir``.  Parquet keeps column pruning and survives the loss
of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidecast-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than there are cores, as with one big file.

    Worth its shuffle before heavy arithmetic only.  Inputs with enough splits,
    the normal case on a cluster, pass through.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def publish(spark: SparkSession, catalogue: str, row: dict[str, str]) -> None:
    """Append one entry to a catalogue: a Parquet folder of one-row files.

    What the entry names must be written before.  The entry shows up when its
    job commits, whole or not at all, so readers never meet half a table.
    """
    schema = ", ".join(f"{name} string" for name in row)
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(catalogue)


def published(spark: SparkSession, catalogue: str, columns: list[str]) -> DataFrame:
    """The entries of a catalogue; one that nothing was published to is empty."""
    schema = ", ".join(f"{name} string" for name in columns)
    try:
        return spark.read.schema(schema).parquet(catalogue)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
