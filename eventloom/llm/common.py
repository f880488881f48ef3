"""Small helpers shared by the operators: columns, shared storage, text rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: a space and the characters 09 to 0D. bytes.split() splits on the same six.
WS_CLASS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine (a local master) without that setting and without a
    checkpoint folder gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        now = context._jsc.sc().getCheckpointDir()
        if now.isDefined():
            found = now.get()
        elif not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
            found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table outlives lost executors. It is deleted by discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/eventloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        if table is not None:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(table.shared_path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def normalised(text: Column) -> Column:
    """Null is empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS, " ")


#: Rows and bytes of the Arrow batches that go to Python; texts are long, so Spark's own defaults would hold too much.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A task that took so many bytes gives memory back at its end.
RELEASE_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has bounds under ours already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in small batches; a worker gives its memory back after each task.

    Workers live on between tasks and stages, and all of an executor's share its memory.
    """
    small_batches(df.sparkSession)

    def released(batches):
        taken = 0

        def counted():
            nonlocal taken
            for batch in batches:
                taken += batch.nbytes
                yield batch

        yield from run(counted())
        if taken < RELEASE_BYTES:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(released, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
