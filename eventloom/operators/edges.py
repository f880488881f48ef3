"""Portfolio edges: upserts within a firm, coverage and spot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names that are part of a page, and the shares from which a firm is flagged.
BOILERPLATE = ("read more", "view all", "learn more", "visit website", "website", "portfolio", "companies", "all", "more")
BOILERPLATE_SHARE, URL_SHARE = 0.3, 0.5


def upsert(edges: DataFrame) -> DataFrame:
    """One row per firm and company: lists united in order, the first address and position that are known.

    edges: investor_id, company_normalized_name, row, stage_at_investment, industry (arrays), company_url, position.
    """
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(c)
    return edges.groupBy("investor_id", "company_normalized_name").agg(F.min("row").alias("row"), united("stage_at_investment"), united("industry"), first("company_url"), first("position"))


def coverage(edges: DataFrame) -> DataFrame:
    """Per firm: edges, companies, and how many edges have each optional column."""
    known = [F.count_if(F.col(c).isNotNull()).alias(f"n_{c}") for c in ("company_url", "position")] + [F.count_if(F.size(c) > 0).alias(f"n_{c}") for c in ("stage_at_investment", "industry")]
    return edges.groupBy("investor_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("company_normalized_name").alias("n_companies"), *known)


def spot_check(edges: DataFrame, first_rows: int = 20) -> DataFrame:
    """Flags of each firm's first rows: boilerplate or addresses in place of names, columns that are always empty."""
    head = edges.withColumn("_n", F.row_number().over(Window.partitionBy("investor_id").orderBy("row"))).filter(F.col("_n") <= first_rows)
    name = F.lower(F.trim("company_name_raw"))
    found = head.groupBy("investor_id").agg(
        (F.avg(name.isin(*BOILERPLATE).cast("int")) >= BOILERPLATE_SHARE).alias("boilerplate_names"),
        (F.avg(name.rlike("^(https?://|/)").cast("int")) >= URL_SHARE).alias("url_names"),
        F.bool_and(F.col("company_url").isNull()).alias("no_url"),
        F.bool_and(F.coalesce(F.size("stage_at_investment"), F.lit(0)) <= 0).alias("no_stage"),
        F.bool_and(F.coalesce(F.size("industry"), F.lit(0)) <= 0).alias("no_industry"),
        F.bool_and(F.col("position").isNull()).alias("no_position"),
    )
    return found


def page_checks(entries: DataFrame, low: int = 1, high: int = 20_000) -> DataFrame:
    """Per page: whether a selector's rows are within bounds and the first three have names. entries: page_id, entry, name."""
    first = F.col("entry") < 3
    return entries.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.lit(1)).between(low, high).alias("in_bounds"), (F.count_if(first & F.col("name").isNull()) == 0).alias("named"))
