"""Tables in the folder that driver and executors share, and global ranks built on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new path in ``spark.checkpoint.dir`` (in a temporary folder only where that is unset, on one machine), deleted when the driver's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
        shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{shared.rstrip('/')}/eventloom-{name}{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows again, from a Parquet table in the shared folder. It outlives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds row numbers over the whole table, from 1, by ascending order, without gathering it in one task.

    Rows are range-partitioned by the order; each takes its place in its partition plus the
    rows of the partitions before. What is summed in one place is a count per partition.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = written(ranged.withColumn("_id", F.monotonically_increasing_id()).drop(*keys))
    part = F.shiftrightunsigned("_id", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = held.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_id") - F.shiftleft("_part", 33) + F.col("_before") + 1).drop("_id", "_part", "_before")
