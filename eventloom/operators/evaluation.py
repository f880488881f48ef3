"""Cohorts, splits and the evaluation of verdicts against outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import stats


def funnel(rows: DataFrame, *stages: str) -> DataFrame:
    """One row: how many rows there are and how many are left after each boolean column, in turn."""
    aggs, so_far = [F.count(F.lit(1)).alias("n_total")], F.lit(True)
    for s in stages:
        so_far = so_far & F.coalesce(F.col(s), F.lit(False))
        aggs.append(F.count_if(so_far).alias(f"n_{s}"))
    return rows.agg(*aggs)


def confusion(cells: DataFrame, cell: str = "cell") -> DataFrame:
    """One row: tp, fp, tn, fn, the rest, precision, recall, F0.5 and its interval from Wilson's bounds."""
    counts = cells.agg(*[F.count_if(F.col(cell) == x.upper()).alias(x) for x in ("tp", "fp", "tn", "fn")], F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("n_filtered", F.col("n") - tp - fp - F.col("tn") - fn)
    out = out.withColumns({"precision": F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0))).otherwise(0.0), "recall": F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0))).otherwise(0.0)})
    p, r = F.col("precision"), F.col("recall")
    (p_low, p_high), (r_low, r_high) = stats.wilson(p, F.nullif(tp + fp, F.lit(0))), stats.wilson(r, F.nullif(tp + fn, F.lit(0)))
    some = (tp + fp > 0) & (tp + fn > 0)
    return out.withColumns({"f05": stats.f_beta(p, r), "f05_low": F.when(some, stats.f_beta(p_low, r_low)).otherwise(0.0), "f05_high": F.when(some, stats.f_beta(p_high, r_high)).otherwise(0.0)})


def quotas(rows: DataFrame, label: str, total: int) -> DataFrame:
    """How many of ``total`` rows each label gets: its share rounded down, and what is left to the largest remainders
    (the later label where they tie).
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    exact = F.col("n") * F.lit(total)
    counts = counts.withColumn("n_all", F.sum("n").over(whole))
    counts = counts.withColumns({"base": F.floor(exact / F.col("n_all")), "rest": exact % F.col("n_all")})
    rank = F.row_number().over(Window.orderBy(F.col("rest").desc(), F.col(label).desc()))
    left = F.lit(total) - F.sum("base").over(whole)
    return counts.withColumn("quota", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("long")).select(label, "n", "quota")


def stratified(rows: DataFrame, label: str, id_col: str, per: int, seed: int) -> DataFrame:
    """At most ``per`` rows of each label, in the order of a seeded hash of the identifier: a sampling operator."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order, id_col))).filter(F.col("_n") <= per).drop("_n")


def leftover(rows: DataFrame, used: DataFrame, id_col: str) -> DataFrame:
    """Rows that no earlier sample has."""
    return rows.join(used.select(id_col), id_col, "left_anti")
