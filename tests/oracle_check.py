"""Run queries against their SQL: python tests/oracle_check.py [sf] [name part ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


# Spark type -> DuckDB type
SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
        "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]",
        "array<int>": "INTEGER[]"}


def compare(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    faults = []
    names, types = list(rel.columns), [str(t) for t in rel.types]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for n, t in zip(names, types):
        if SAME.get(spark_types[n]) != t:
            faults.append(f"type of {n}: {spark_types[n]} vs {t}")
    order = sorted(names)
    mine = sorted((tuple(_plain(row[n]) for n in order) for row in df.collect()), key=repr)
    at = [names.index(n) for n in order]
    theirs = sorted((tuple(_plain(row[i]) for i in at) for row in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        faults.append(f"rows {len(mine)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        faults.append(f"{len(bad)} rows differ over {order}, first {bad[:2]}")
    if not mine:
        faults.append("no rows")
    return faults


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main() -> int:
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                faults = compare(df, con, sqls[name])
                note = "value"
            else:
                rows = df.collect()
                faults, note = ([] if rows else ["no rows"]), f"rows={len(rows)}"
        except Exception as e:  # noqa: BLE001
            faults, note = [f"{type(e).__name__}: {str(e)[:700]}"], "error"
        failed += bool(faults)
        print(f"{'FAIL' if faults else 'ok  '} {name} {note} {time.time() - start:.1f}s", *faults,
              sep="\n     " if faults else " ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
