"""Helpers shared by the operators: shared-folder tables and small expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where it is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="examlake-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows of a narrow table that go to one file.
FILE_ROWS = 200_000
#: Rows with whole texts that go to Python at a time.
TEXT_ROWS = 2_000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within it, plans that run send TEXT_ROWS rows to Python at a time: whole texts are held by the JVM, Arrow and Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, and values that depend on the partitioning (row numbers) are fixed.
    Partitions are merged by their bytes at run time (AQE), so tasks don't grow
    with the table. Only where that is switched off, they are merged to a few
    for each core, with many shuffle partitions 16 to a task, so that small
    tables don't become thousands of files. rows, an upper bound of a narrow
    table's rows, makes that a file for each FILE_ROWS of them.
    """
    spark = df.sparkSession
    files = None if rows is None else max(1, -(-rows // FILE_ROWS))
    if any(spark.conf.get(f"spark.sql.adaptive.{k}", "true") == "false" for k in ("enabled", "coalescePartitions.enabled")):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = max(3 * spark.sparkContext.defaultParallelism, partitions // 16, 1)
        files = most if files is None else min(files, most)
    if files is not None:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more (it does so only after the driver collects garbage)."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads, and the shuffle files of what is gone."""
    for t in tables:
        path = getattr(t, "_table_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if tables:
        release(tables[0].sparkSession)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unit_hash(*cols: Column) -> Column:
    """A draw from (0, 1) that only the given values decide."""
    h = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (h + F.lit(0.5)) * F.lit(2.0**-53)


def quiet_worker() -> None:
    """Keep libraries in a Python worker to one thread each, and Arrow to an allocator that gives memory back."""
    import pyarrow as pa

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    pa.set_cpu_count(1)
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return a Python worker's freed memory to the machine; workers live on between tasks, beside the JVM."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
