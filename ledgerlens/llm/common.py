"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (tests) is a local one
    made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from reliable storage: lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same rows, read back from Parquet under path, a folder of the shared one: lineage
    ends here. Unlike a checkpoint this computes them once, compresses them, and gives the
    next stage tasks by bytes: few small rows of many partitions do not stay many tasks."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes what was stored there, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fresh(base: str, taken: list[str]) -> str:
    """A column name like base that none of the taken ones equals (case ignored)."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def unit_hash(*columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def sliced(batches, rows: int = 256):
    """Arrow batches in short slices (views), so that what a worker makes of a batch at once
    does not depend on Spark's batch size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def lean(batches):
    """The batches; what a reused Python worker still holds of earlier work, and then of
    these, goes back to the machine before the first and after the last one."""
    import gc

    import pyarrow as pa

    def give_back() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own ways
            ctypes.CDLL(None).malloc_trim(0)

    give_back()
    yield from batches
    give_back()


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def short_batches(spark: SparkSession, rows: int = 256):
    """Jobs run inside hand Python at most so many rows at once (rows of two texts can be
    long); the session's own setting comes back afterwards."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def swept(spark: SparkSession):
    """Shuffle files of an action inside go when it ends, not when the driver happens to
    collect its garbage. For frames that are stored once and not run again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
