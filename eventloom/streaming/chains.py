"""Chains kept up to date from a stream of events.

Late or new events change only their companies. Each micro-batch is appended to the event
store, once for every identifier, and the chains of the buckets it touches are made anew
and replace their partitions; a batch that runs again after a failure gives the same. Only
touched buckets of the store are read. There should be so many buckets that a batch touches
few: their number is the store's, given when it is begun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import chains

BUCKETS = 64


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("company_id"), F.lit(buckets)).cast("int")


def update(batch: DataFrame, store: str, out: str, buckets: int = BUCKETS) -> None:
    """For foreachBatch: events (event_id, company_id, event_type, family, day) into the store, their buckets' chains into ``out``."""
    spark = batch.sparkSession
    batch = batch.withColumn("bucket", bucket(buckets))
    touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # as many numbers as buckets at most
    if not touched:
        return
    fresh = batch.dropDuplicates(["event_id"])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.parquet(store).filter(F.col("bucket").isin(touched))
        fresh = fresh.join(known.select("event_id", "bucket"), ["event_id", "bucket"], "left_anti")
    fresh.write.mode("append").partitionBy("bucket").parquet(store)
    events = spark.read.parquet(store).filter(F.col("bucket").isin(touched))
    outcomes = events.filter("family = 'outcome'").groupBy("company_id", "event_type", F.col("day").cast("string").alias("announce_date")).agg(F.count(F.lit(1)).alias("n")).withColumn("round_name", F.lit(None).cast("string"))
    made = chains.sequence_outcomes(outcomes).select("company_id", "chain_sequence", "end", "chain_id")
    middle = chains.assign_events(made, events.filter("family <> 'outcome'").select("company_id", "day", "event_id"))
    counts = middle.groupBy("company_id", "chain_sequence").agg(F.count(F.lit(1)).alias("n_middle"))
    rows = made.join(counts, ["company_id", "chain_sequence"], "left").withColumn("n_middle", F.coalesce("n_middle", F.lit(0))).withColumn("bucket", bucket(buckets))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)


def start(events: DataFrame, store: str, out: str, checkpoint: str, buckets: int = BUCKETS):
    """A query that runs over all that is there and stops; events: a streaming DataFrame."""
    return events.writeStream.foreachBatch(lambda df, _: update(df, store, out, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows, with a watermark. events: ts, event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
