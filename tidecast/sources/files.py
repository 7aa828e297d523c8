"""Reading and writing CSV, Parquet and JSON."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.storage import scratch_path, written_table

CORRUPT = "_corrupt"
WHOLE_FILE = str(1 << 50)


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a partition; the rest is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def header_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, header``: the first line of every file that has one.

    One task a file, which stops after its first batch of lines.  The settings
    that keep files apart are those of a session of its own.
    """
    apart, path = spark.newSession(), scratch_path(spark, "headers")
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(setting, WHOLE_FILE)
    apart.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = apart.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header"))
    lines.mapInArrow(_first_line, "file string, header string").write.parquet(path)
    return spark.read.schema("file string, header string").parquet(path)


def header_names(line: str) -> list[str]:
    """Column names of a header line; missing ones are numbered, repeated ones get ``_2``, ``_3``."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]), [])):
        name, taken = name.strip() or f"_c{i}", {n.lower() for n in names}
        again, plain = 2, name
        while name.lower() in taken:
            name, again = f"{plain}_{again}", again + 1
        names.append(name)
    return names


def _literal(file: str) -> str:
    """A file's URI as a path without escapes, its pattern signs taken literally."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(file))


def scan_csv(spark: SparkSession, path: str | list[str], hints: T.StructType | None = None) -> DataFrame:
    """Scan CSV files with headers; rows that do not fit keep their raw line in ``_corrupt``.

    Every file is read by its own header, so files may have other orders or
    sets of columns; a column that a file lacks is null there, and names are
    the same whatever their case.  Columns come as text, ready for
    ``cleanse.infer_types``, or parsed to their hinted type.  Lines with too
    many or too few fields, or with a value its type cannot take, are marked.
    An unreadable path fails at once, and so does a hint for an unknown column.
    Headers may not span lines.
    """
    paths = [path] if isinstance(path, str) else list(path)
    headers = header_lines(spark, paths)
    kinds = sorted(r["header"] for r in headers.select("header").distinct().collect())
    types = {f.name.lower(): f for f in hints or ()}
    unknown = types.keys() - {n.lower() for line in kinds for n in header_names(line)}
    if unknown and kinds:
        raise ValueError(f"no header has the hinted columns {sorted(unknown)}")
    # Pruned columns would not be parsed, and their faults would go unseen.
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    corrupt = T.StructField(CORRUPT, T.StringType())

    def read(line: str) -> DataFrame:
        fields = [types.get(n.lower(), T.StructField(n, T.StringType())) for n in header_names(line)]
        files = paths if len(kinds) == 1 else [
            _literal(r["file"]) for r in headers.where(F.col("header") == line).select("file").collect()]
        return reader.schema(T.StructType([*fields, corrupt])).csv(files)

    if not kinds:
        return spark.createDataFrame([], T.StructType([*(hints.fields if hints else []), corrupt]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, kinds))
    return whole.select(*[F.col(f"`{c}`") for c in whole.columns if c != CORRUPT], CORRUPT)


def malformed_rows(scan: DataFrame) -> DataFrame:
    """Raw lines the scan could not parse, with the fields it could.

    The lines are written out, so they are kept even when the input goes away.
    """
    fields = [c for c in scan.columns if c != CORRUPT]
    broken = scan.where(F.col(CORRUPT).isNotNull())
    return written_table(broken.select(F.col(CORRUPT).alias("raw_line"), *fields), "malformed")


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> str:
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return path


def finite(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null, so JSON readers accept every number."""
    def clean(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            return F.when(~bad, c).alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(f.name).cast("string").alias(f.name)
        return F.col(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> str:
    finite(df).write.json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
