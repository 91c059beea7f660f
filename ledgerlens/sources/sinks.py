"""Writing results: partitioned tables, summaries, exports with manifests and gates."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import require


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only
    where the session names none and runs on this machine alone, as in tests, a local one is
    made; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sanitised(rows: DataFrame) -> DataFrame:
    """Column names of letters, digits and underscores; repeats get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in rows.columns:
        base = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z_]", "_", c)).strip("_") or "column"
        seen[base.lower()] = seen.get(base.lower(), 0) + 1
        names.append(base if seen[base.lower()] == 1 else f"{base}_{seen[base.lower()]}")
    return rows.toDF(*names)


def write_partitioned(rows: DataFrame, path: str, by: list[str], most_rows: int = 5_000_000) -> None:
    """Parquet by partition columns, overwritten. Rows are dealt by the columns first, and a
    large partition is split by the adaptive rebalance, so neither one task nor one file has
    to hold it."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy(*by).parquet(path)


def materialised(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written to a shared path and read again: a barrier in the lineage."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def settled(rows: DataFrame) -> DataFrame:
    """The rows behind such a barrier at a path of its own: what several branches of a plan
    read is computed once, its size is known to the planner, and a lost executor costs no
    more than the branch."""
    return materialised(rows, scratch(rows.sparkSession, "settled"))


def write_summary(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON row of run figures."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).coalesce(1).write.mode("overwrite").json(path)


def export(tables: dict[str, tuple[DataFrame, str]], path: str, run: str, today: str | None = None) -> DataFrame:
    """Small result tables as CSV, each in a folder, and a manifest of name, rows,
    description, run and date, which is written and returned."""
    spark, rows = None, []
    for name, (df, about) in tables.items():
        spark = df.sparkSession
        df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True)
        n = spark.read.csv(f"{path}/{name}", header=True).count()
        rows.append((name, n, about, run, today or date.today().isoformat()))
    manifest = spark.createDataFrame(rows, "table string, n_rows long, description string, run string, written string")
    manifest.coalesce(1).write.mode("overwrite").csv(f"{path}/manifest", header=True)
    return manifest


def control(rows: DataFrame, value, expected: float, tolerance: float) -> DataFrame:
    """One row: a control value, what it has to be, and whether it is within the tolerance."""
    return rows.agg(value.cast("double").alias("value")).withColumn("expected", F.lit(expected)).withColumn("ok", F.abs(F.col("value") - expected) <= tolerance)


def gated_export(check: DataFrame, tables: dict[str, tuple[DataFrame, str]], path: str, run: str) -> DataFrame:
    """export, withheld (an error) unless the control value reproduces."""
    require(check)
    return export(tables, path, run)
