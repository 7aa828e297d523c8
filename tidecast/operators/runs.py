"""Runs that keep their tables, and the catalogue of those that were finished."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidecast.storage import publish, published

_ENTRY = ["run_id", "folder", "manifest"]
LOG = "stage string, reason string, rows_in bigint, rows_out bigint"


@dataclass
class StoredRun:
    """Tables under ``folder/run_id``; nobody sees them before ``finish``.

    The filters of a run count the rows they get and pass while they run, so
    the log costs no job of its own.  A filter counts when a table behind it is
    stored.
    """

    spark: SparkSession
    folder: str
    run_id: str
    tables: dict[str, str] = field(default_factory=dict)
    _filters: list[tuple[str, str, Observation, Observation]] = field(default_factory=list)

    def keep(self, df: DataFrame, stage: str, condition: Column, reason: str) -> DataFrame:
        """Rows that meet ``condition`` (unknown counts as not met), with both counts in the log."""
        before, after = Observation(), Observation()
        self._filters.append((stage, reason, before, after))
        passed = df.observe(before, F.count(F.lit(1)).alias("n")).where(condition)
        return passed.observe(after, F.count(F.lit(1)).alias("n"))

    def store(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"run {self.run_id} has a table {name} already")
        path = f"{self.folder}/{self.run_id}/{name}"
        df.write.parquet(path)
        self.tables[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, **facts: str | int | float | bool | None) -> None:
        """Store the row log, then publish the manifest; only now the run exists for others."""
        log = [(stage, reason, before.get["n"], after.get["n"]) for stage, reason, before, after in self._filters]
        self.store("row_log", self.spark.createDataFrame(log, LOG))
        manifest = {"tables": self.tables, **facts}
        publish(self.spark, f"{self.folder}/catalogue", {
            "run_id": self.run_id, "folder": self.folder, "manifest": json.dumps(manifest, sort_keys=True, default=str)})


def stored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, folder, manifest`` of finished runs, newest first."""
    return published(spark, f"{folder}/catalogue", _ENTRY).orderBy(F.desc("run_id"))


def load_table(spark: SparkSession, folder: str, run_id: str, name: str) -> DataFrame:
    """A table of a finished run."""
    entry = stored_runs(spark, folder).where(F.col("run_id") == run_id).first()
    if entry is None:
        raise ValueError(f"no finished run {run_id} in {folder}")
    return spark.read.parquet(json.loads(entry["manifest"])["tables"][name])
