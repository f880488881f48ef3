"""From flags per chain to companies, 2 x 2 tables and action values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats


def company_profiles(companies: DataFrame, flagged: DataFrame, patterns: list[str]) -> DataFrame:
    """One row per company, chains or not: n_chains, and for each pattern how many chains have it and whether any does.

    companies: company_id, label; flagged: company_id and a boolean for each pattern (null: not evaluable).
    """
    aggs = [F.count(F.lit(1)).alias("n_chains")]
    for p in patterns:
        aggs += [F.count_if(F.col(p)).alias(f"{p}_count"), F.bool_or(p).alias(f"{p}_any")]
    out = companies.join(flagged.groupBy("company_id").agg(*aggs), "company_id", "left")
    return out.withColumn("n_chains", F.coalesce("n_chains", F.lit(0)))


def two_by_two(profiles: DataFrame, patterns: list[str]) -> DataFrame:
    """Long form: pattern, and how many companies take it or not, by label. Companies without an evaluable chain are left out."""
    stacked = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"{p}_any").alias("taking")) for p in patterns]))
    rows = profiles.select("company_id", "label", stacked.alias("p")).select("label", "p.*").filter(F.col("taking").isNotNull() & F.col("label").isin("SUCCESS", "FAILURE"))
    success = F.col("label") == "SUCCESS"
    return rows.groupBy("pattern").agg(
        F.count_if(F.col("taking") & success).alias("success_taking"),
        F.count_if(F.col("taking") & ~success).alias("failure_taking"),
        F.count_if(~F.col("taking") & success).alias("success_not_taking"),
        F.count_if(~F.col("taking") & ~success).alias("failure_not_taking"),
    )


def action_values(table: DataFrame, p_values: bool = False) -> DataFrame:
    """Adds the rates, their difference, chi-square and the class; with p_values also the p-value (an Arrow function)."""
    s1, s0 = F.col("success_taking"), F.col("success_not_taking")
    n1, n0 = s1 + F.col("failure_taking"), s0 + F.col("failure_not_taking")
    both = (n1 > 0) & (n0 > 0)
    out = table.withColumns(
        {
            "taking_success_rate": F.when(n1 > 0, s1 / n1),
            "not_taking_success_rate": F.when(n0 > 0, s0 / n0),
            "ate_success": F.when(both, s1 / F.nullif(n1, F.lit(0)) - s0 / F.nullif(n0, F.lit(0))),
            "chi_square": F.when(both, stats.chi_square(s1, n1, s0, n0)),
        }
    )
    result = F.when(both, stats.action_value(s1, F.nullif(n1, F.lit(0)), s0, F.nullif(n0, F.lit(0)))).otherwise("INSUFFICIENT_PATTERN_SUPPORT")
    out = out.withColumn("result", result)
    return out.withColumn("p_value", stats.chi2_p("chi_square")) if p_values else out


def registry(batches: DataFrame, *more: DataFrame) -> DataFrame:
    """Action-eligible records of all batches; a repeated identifier is an error when the rows are read."""
    rows = batches
    for df in more:
        rows = rows.unionByName(df)
    rows = rows.filter(F.col("track") == "ACTION_ELIGIBLE")
    repeated = rows.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(repeated, "pattern_id")
    return joined.withColumn("pattern_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated pattern "), "pattern_id")).cast("string")).otherwise(F.col("pattern_id"))).drop("_n")
