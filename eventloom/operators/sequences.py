"""Sequences of events over exploded rows: no chain's events are ever in one row.

Step k + 1 may follow an event of step k that ended ``gap`` days before it starts, and, with a
largest gap, started late enough. So each step asks, for every event, for the latest start
among the events of the step before whose end lies ``gap`` days back or more: a running
maximum by date. It is taken in two parts, inside each month and over the months'
maxima, so that a chain of any length is dealt over as many tasks as it has months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.storage import written
from eventloom.plans.rules import event_test


def running_max(rows: DataFrame, keys: list[str], point: str, value: str, name: str) -> DataFrame:
    """Adds the largest value of the rows with the same keys whose point isn't after this row's."""
    rows = rows.withColumn("_month", F.trunc(point, "month"))
    inside = Window.partitionBy(*keys, "_month").orderBy(point).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    months = rows.groupBy(*keys, "_month").agg(F.max(value).alias("_top"))
    ahead = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*keys, "_month", F.max("_top").over(ahead).alias("_ahead"))
    rows = rows.withColumn("_inside", F.max(value).over(inside)).join(months, [*keys, "_month"])
    return rows.withColumn(name, F.greatest("_inside", "_ahead")).drop("_month", "_inside", "_ahead")


def matches(events: DataFrame, rule: dict, key: str = "chain_id") -> DataFrame:
    """The keys of the chains that a sequence rule holds for, once each.

    events: ``key``, family, the event fields that the rule names, lo and hi (dates). Rows
    without dates, or with a null in a field that must be the same, take no part.
    """
    same, n = [f[6:] for f in rule["same_values"]], len(rule["steps"])
    gap, high = max(1, rule["min_gap_days"] or 0), rule["max_gap_days"]
    keys = [f"_k{i}" for i in range(len(same) + 1)]
    event = F.struct(*[F.col(c) for c in events.columns])
    tests = [event_test(s)(event).alias(f"_t{k}") for k, s in enumerate(rule["steps"])]
    rows = events.select(*[F.col(c).alias(k) for k, c in zip(keys, [key, *same])], "lo", "hi", *tests)
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("lo", *keys)]) & reduce(lambda a, b: a | b, [F.col(f"_t{k}") for k in range(n)]))
    rows = written(rows) if n > 2 else rows
    reached = rows.filter("_t0")
    for k in range(1, n):
        before = reached.groupBy(*keys, F.date_add("hi", gap).alias("_at")).agg(F.max("lo").alias("_start")).withColumn("hi", F.lit(None).cast("date"))
        after = rows.filter(f"_t{k}").select(*keys, F.col("lo").alias("_at"), F.lit(None).cast("date").alias("_start"), "hi").distinct()
        both = running_max(before.unionByName(after), keys, "_at", "_start", "_latest").filter("hi IS NOT NULL")
        reached = both.filter(_follows(F.col("_latest"), F.col("hi"), high)).select(*keys, F.col("_at").alias("lo"), "hi")
    return reached.select(F.col(keys[0]).alias(key)).distinct()


def _follows(latest: Column, end: Column, high: int | None) -> Column:
    return latest.isNotNull() if high is None else F.date_add(latest, high) >= end
