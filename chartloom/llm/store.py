"""Tables written to the folder all executors share, to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops

BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def _one_process(spark: SparkSession) -> bool:
    """Whether the driver's JVM is the only one (local mode)."""
    return spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not _one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chartloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chartloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of what stands
    before, and row numbers given before the write stay as they are.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame, but: DataFrame | None = None) -> None:
    """Delete the tables of materialise() that these read, when nothing will read them again; not those that ``but`` reads."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    ours = path_of(f"{shared_dir(spark)}/chartloom").toUri().getPath()
    folders = lambda *read: {path_of(file).getParent().toString() for df in read for file in df.inputFiles()}
    for path in folders(*tables) - (folders(but) if but is not None else set()):
        path = path_of(path)
        if path.getParent().toUri().getPath() == ours:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that have ended, before the next ones are written.

    The cleaner works when the driver's heap is collected, which otherwise may take half an hour.  Spark
    holds on to the plan that ran last, so a small one runs first.
    """
    gc.collect()
    spark.range(1).collect()
    spark._jvm.System.gc()


def rest(spark: SparkSession, python: bool = True) -> None:
    """release(), and let executors and their Python workers give memory that earlier steps took back to the system.

    An executor's heap only grows while it works, and G1 returns what is free of it after a full collection alone.
    A step that begins so is as large as by itself, whatever ran before it.  With python=False, for steps of DataFrame
    operations only, no worker is asked: those that stand idle hold what their last tasks left until Spark ends them.
    """
    release(spark)
    # as many tasks as there are cores, so that each idle executor gets some; the driver's heap was collected above
    n = spark.sparkContext.defaultParallelism
    tasks = spark.range(0, n, 1, n)
    if python:
        ship(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            textops.lighten()
            textops.settle()
            yield from batches

        tasks = tasks.mapInArrow(run, "id long")
    if not _one_process(spark):
        tasks = tasks.select(F.reflect(F.lit("java.lang.System"), F.lit("gc")))
    tasks.collect()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also when it isn't installed there (local mode), and bound their batches by bytes."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    if spark.conf.get(BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
