"""The driver's tables in the roles of the engine's tables.

* company: events.user_id; outcome: a purchase; exposure: view, click, error; interface: signup.
* partial dates: an event's day, cut to a year or a month by event_id % 10.
* investor: supplier; company: customer; evidence: orders; interface events: lineitem ships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPOSURE, INTERFACE, OUTCOME = ("view", "click", "error"), ("signup",), "purchase"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, company_id, event_type, family, event_date (partial), day, value."""
    rows = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    digit = F.col("event_id") % 10
    family = F.when(F.col("event_type").isin(*EXPOSURE), "exposure").when(F.col("event_type").isin(*INTERFACE), "interface").otherwise("outcome")
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").alias("company_id"),
        "event_type",
        family.alias("family"),
        F.when(digit == 0, F.substring(day, 1, 4)).when(digit.isin(1, 2), F.substring(day, 1, 7)).otherwise(day).alias("event_date"),
        F.to_date("ts").alias("day"),
        "value",
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company and purchase day, as sequence_outcomes() takes them."""
    rows = events(spark, sf_dir).filter(F.col("event_type") == OUTCOME)
    return rows.groupBy("company_id", "event_type", F.col("day").cast("string").alias("announce_date")).agg(F.count(F.lit(1)).alias("n_participant_rows")).withColumn("round_name", F.lit(None).cast("string"))


#: The same as DuckDB CTEs.
EVENTS_SQL = """ev AS (SELECT event_id::VARCHAR AS event_id, user_id AS company_id, event_type,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN 'exposure' WHEN event_type = 'signup' THEN 'interface' ELSE 'outcome' END AS family,
  CASE WHEN event_id % 10 = 0 THEN strftime(ts, '%Y') WHEN event_id % 10 IN (1, 2) THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS event_date,
  ts::DATE AS day, value FROM events)"""
OUTCOMES_SQL = """oc AS (SELECT company_id, event_type, day AS end_day, count(*) AS n_participant_rows FROM ev WHERE event_type = 'purchase' GROUP BY ALL)"""
CHAINS_SQL = """ch AS (SELECT company_id, event_type, end_day, n_participant_rows, row_number() OVER w AS chain_sequence, lag(end_day) OVER w AS start_day
  FROM oc WINDOW w AS (PARTITION BY company_id ORDER BY end_day))"""
#: Events with the interval of their partial dates.
INTERVALS_SQL = """iv AS (SELECT *, CASE length(event_date) WHEN 4 THEN (event_date || '-01-01')::DATE WHEN 7 THEN (event_date || '-01')::DATE ELSE event_date::DATE END AS lo,
  CASE length(event_date) WHEN 4 THEN (event_date || '-12-31')::DATE WHEN 7 THEN last_day((event_date || '-01')::DATE) ELSE event_date::DATE END AS hi FROM ev)"""


def deals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(evidence, events) of supplier-nation pairs: orders of small quantities as evidence, shipments as interface events."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Orders meet their customers first, so the lines are dealt out once.
    both = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    pair = [F.col("l_suppkey").alias("investor_id"), F.col("c_nationkey").alias("company_id")]
    evidence = both.filter(F.col("l_quantity") <= 2).select(*pair, F.to_date("o_orderdate").alias("lo"), F.to_date("o_orderdate").alias("hi"))
    digit = F.col("l_linenumber") % 4
    kind = F.when(digit == 0, "exit").when(digit == 1, "board_change").when(digit == 2, "strategic_investment").otherwise("funding_participation")
    moves = both.select(
        *pair,
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("event_id"),
        kind.alias("event_type"),
        F.when(F.col("l_orderkey") % 10 == 0, F.date_format("l_shipdate", "yyyy-MM")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("event_date"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILURE").otherwise("AMBIGUOUS").alias("company_label"),
    )
    return evidence, moves


DEALS_SQL = """b3 AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
evd AS (SELECT l_suppkey AS investor_id, c_nationkey AS company_id, o_orderdate::DATE AS lo, o_orderdate::DATE AS hi FROM b3 WHERE l_quantity <= 2),
mv AS (SELECT l_suppkey AS investor_id, c_nationkey AS company_id, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS event_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'exit' WHEN 1 THEN 'board_change' WHEN 2 THEN 'strategic_investment' ELSE 'funding_participation' END AS event_type,
  CASE WHEN l_orderkey % 10 = 0 THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS event_date,
  CASE WHEN l_orderkey % 10 = 0 THEN date_trunc('month', l_shipdate)::DATE ELSE l_shipdate::DATE END AS lo,
  CASE WHEN l_orderkey % 10 = 0 THEN last_day(l_shipdate::DATE) ELSE l_shipdate::DATE END AS hi,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILURE' ELSE 'AMBIGUOUS' END AS company_label FROM b3)"""
