"""Exact quantiles and histograms of each key, without gathering a key's values in one task.

A mergeable sketch (``percentile_approx``, whose rank error is n / ACCURACY at most) gives the
values at each hundredth, so two that enclose each wanted rank. Values under them are only counted, those
over them left out; of those inside, three hundredths at most besides repeats, which are one row, a
running count finds the rank. A key of few values needs no bounds, and one running count for all ranks.
Nothing is approximate.

Defined cases: null and NaN values don't count; a key without values has no row; null is a key like others;
repeated values count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 1000


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, one column for each name): the value at each rank, from 1, of a key's values in ascending order.

    ranks: by name, as Columns of ``n``, the number of the key's values; they must lie between 1 and n.
    """
    kept = rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    grid = [k / 100 for k in range(101)]
    sketch = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", grid, ACCURACY).alias("_grid"))
    rank_of = {name: rank.cast("long") for name, rank in ranks.items()}
    # The grid's value for a share is off by n / ACCURACY ranks at most; one step of the grid is ten times that.
    step = lambda r: F.floor((r - 1) * 100 / F.col("n"))
    below = lambda r: F.when(step(r) >= 1, F.get("_grid", (step(r) - 1).cast("int")))
    above = lambda r: F.when(step(r) <= 97, F.get("_grid", (step(r) + 2).cast("int")))
    part = lambda name, low, high: F.struct(name.cast("string").alias("name"), low.alias("_low"), high.alias("_high"))
    nothing = F.get("_grid", F.lit(-1))
    # A key of few values has one part, all of them, from which every rank is read; else each rank has its own.
    parts = F.when(F.col("n") > ACCURACY, F.array(*[part(F.lit(name), below(r), above(r)) for name, r in rank_of.items()])).otherwise(F.array(part(F.lit(None), nothing, nothing)))
    bounds = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", F.explode(parts).alias("w")).select(*[f"_k{i}" for i in range(len(keys))], "n", "w.*")
    counted = kept.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    met = counted.join(bounds, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    under = F.col("_low").isNotNull() & (F.col("_v") < F.col("_low"))
    inside = ~under & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    # What lies under the bounds becomes one row, which the running count starts from.
    place = F.when(under, F.lit(None)).otherwise(F.col("_v"))
    short = met.filter(under | inside).groupBy(*keys, "n", "name", place.alias("_v")).agg(F.sum("_c").alias("_c"))
    order = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = lambda name: (F.col("name").isNull() | (F.col("name") == name)) & (F.col("_upto") >= rank_of[name]) & (F.col("_upto") - F.col("_c") < rank_of[name])
    found = short.withColumn("_upto", F.sum("_c").over(order)).filter(reduce(lambda x, y: x | y, map(hit, ranks)))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(hit(name), F.col("_v"))).alias(name) for name in ranks])


def share(p: float) -> Column:
    """The rank of the least value that a share ``p`` of the values doesn't exceed."""
    return F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))


def medians(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(keys, n, median, one column for each of shares): the median is the mean of the two middle values where n is even."""
    ranks = {"_a": F.floor((F.col("n") + 1) / 2), "_b": F.floor(F.col("n") / 2) + 1} | {name: share(p) for name, p in (shares or {}).items()}
    found = at_ranks(rows, keys, value, ranks)
    return found.withColumn("median", (F.col("_a") + F.col("_b")) / 2).select(*keys, "n", "median", *(shares or {}))


def histogram(rows: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """(keys, bin, n): how many values lie in [bin * width, (bin + 1) * width)."""
    kept = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*keys, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
