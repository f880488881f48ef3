"""Queries on sources, outcome groups, matching of names, event rows, candidates and their rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import names
from eventloom.operators import behavior, chains, quantiles
from eventloom.plans import analogues as a
from eventloom.plans import catalog_chains as base
from eventloom.sources import readers

TYPES = ("funding_round", "funding_failed", "acquired")


def projected_scan(spark, sf_dir):
    """Two columns of a wide table and an optional one that its files lack, summed up by the first."""
    rows = readers.parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag", "l_quantity", "note"], {"note": "string"})
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.count("note").alias("n_notes"))


def footer_counts(spark, sf_dir):
    """Rows and columns of the tables, from their footers."""
    found = [(t, *readers.footer(spark, f"{sf_dir}/{t}.parquet")) for t in ("customer", "documents", "lineitem", "orders", "pages")]
    return spark.createDataFrame([(t, n, ",".join(sorted(c))) for t, n, c in found], "name string, n_rows long, columns string")


def tagged_sources(spark, sf_dir):
    """Customers and suppliers as one table that says where each row is from; a source that isn't required is missing."""
    rows = readers.per_source(spark, {"customer": (f"{sf_dir}/customer.parquet", True), "supplier": (f"{sf_dir}/supplier.parquet", True), "broker": (f"{sf_dir}/broker.parquet", False)})
    return rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_customers"), F.count("s_suppkey").alias("n_suppliers")).withColumnRenamed("_source", "source")


def _participants(spark, sf_dir):
    """Lines of orders as participants' rows of outcomes: two customers in five hundred a company, a month as date, some rounds without a name."""
    lines = a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    k = F.col("o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == k).select(
        F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 2).alias("event_id"),
        (F.col("o_custkey") % 200).alias("company_id"),
        F.when(F.col("o_orderstatus") == "F", "funding_round").otherwise("acquired").alias("event_type"),
        F.when(k % 3 > 0, F.concat(F.lit("Series "), F.chr(F.lit(65) + k % 3))).alias("round_name"),
        F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM")).alias("announce_date"),
        F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("i"), F.col("l_suppkey").cast("string"))).alias("investor_id"),
        F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("Name "), (F.col("l_suppkey") % 30).cast("string"))).alias("raw_investor_name"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_suppkey")).alias("ord"),
    )


def outcome_groups(spark, sf_dir):
    made = chains.group_outcomes(_participants(spark, sf_dir))
    text = lambda c: F.array_join(c, ",").alias(c)
    return made.select("company_id", "event_type", "round_name", "announce_date", "n_participant_rows", text("outcome_event_ids"), text("investor_ids"), text("investor_raw_names"))


def outcome_chains(spark, sf_dir):
    """Grouped outcomes in the order of their chains."""
    made = chains.sequence_outcomes(chains.group_outcomes(_participants(spark, sf_dir)))
    return made.select("company_id", "event_type", "round_name", "announce_date", "chain_sequence", "start", "end", "chain_id", "n_participant_rows")


def _investors(spark, sf_dir):
    s = F.col("s_suppkey")
    slug = F.when(s % 3 == 0, F.concat(F.lit("beta "), (s % 20).cast("string"))).otherwise(F.concat(F.lit("supplier-"), (s % 50).cast("string")))
    return a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), s.cast("string")).alias("investor_id"), slug.alias("slug"), s.alias("row"))


def investor_match(spark, sf_dir):
    """Names by their slug, else by their normalized name; and by the normalized name alone."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("SUPPLIER  "), (k % 60).cast("string"))).when(k % 5 == 1, F.concat(F.lit("Beta "), (k % 25).cast("string"), F.lit(" Capital, LLC"))).when(k % 5 == 2, F.concat(F.lit("beta "), (k % 25).cast("string"))).when(k % 5 == 3, "")
    rows = a.table(spark, sf_dir, "customer").select("c_custkey", name.alias("raw_investor_name"))
    two = chains.match_investors(rows, _investors(spark, sf_dir), "raw_investor_name")
    one = chains.match_by_name(two.withColumnRenamed("investor_id", "by_slug_then_name"), _investors(spark, sf_dir))
    return one.select("c_custkey", "raw_investor_name", "by_slug_then_name", F.col("investor_id").alias("by_name"))


def event_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = a.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 4 == 0, "").when(k % 4 == 1, "acquired").when(k % 4 == 2, "funding_failed").otherwise("rumour").alias("event_type"),
        F.when(k % 3 == 0, "2021-02-30").when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"),
        F.when(k % 5 == 0, "many").when(k % 5 == 1, "").otherwise(k.cast("string")).alias("amount_usd"),
        F.when(k % 6 > 0, F.concat(F.lit("0."), (k % 10).cast("string"))).alias("confidence"),
        F.when(k % 2 == 0, " Series  A ").alias("round_name"),
    )
    return chains.event_rows(rows, TYPES, strict=False, default_type="funding_round")


def name_folding(spark, sf_dir):
    """Names beyond ASCII: folded letters, wide letters, and white space that only looks like a space."""
    k = F.col("p_partkey")
    words = F.array(*map(F.lit, ("Straße", "ÉCOLE Saint-Éloi", "ΣΟΦΟΣ Κόσμος", "Ｆｕｎｄ　Ａ", "ﬁne Capital", "Plain Name", "Æther Holdings", "ŠKODA Auto")))
    raw = F.concat(F.element_at(words, (k % 8 + 1).cast("int")), F.lit("  "), (k % 50).cast("string"))
    rows = a.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", names.dedup_key(F.col("raw")).alias("dedup"), names.exact_name(F.col("raw")).alias("exact"), names.identity(F.col("raw")).alias("identity"), names.identity(F.col("raw"), compatible=True).alias("compatible"))


def candidate_rankings(spark, sf_dir):
    return behavior.rankings(behavior.comparison_table(base._support(spark, sf_dir)))


def candidate_signatures(spark, sf_dir):
    return behavior.signature_groups(behavior.comparison_table(base._support(spark, sf_dir)))


def _confirmed(spark, sf_dir):
    return base._related(spark, sf_dir).filter(F.col("temporal_relation_status") == behavior.CONFIRMED)


def confirmed_distributions(spark, sf_dir):
    return behavior.distributions(_confirmed(spark, sf_dir))


def investor_types(spark, sf_dir):
    s = F.col("s_suppkey")
    kinds = F.array_compact(F.array(F.when(s % 2 == 0, F.lit("vc")), F.when(s % 3 == 0, F.lit("bank")), F.when(s % 5 == 0, F.lit("vc"))))
    types = a.table(spark, sf_dir, "supplier").select(s.alias("investor_id"), kinds.alias("investor_types"))
    return behavior.type_summary(_confirmed(spark, sf_dir), types)


_PARTS = """pt AS (SELECT l_orderkey || '-' || l_linenumber % 2 AS event_id, o_custkey % 200 AS company_id, CASE WHEN o_orderstatus = 'F' THEN 'funding_round' ELSE 'acquired' END AS event_type, CASE WHEN o_orderkey % 3 > 0 THEN 'Series ' || chr((65 + o_orderkey % 3)::INT) END AS round_name,
    CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS announce_date, CASE WHEN l_linenumber % 3 > 0 THEN 'i' || l_suppkey END AS investor_id, CASE WHEN l_linenumber % 4 > 0 THEN 'Name ' || l_suppkey % 30 END AS raw_investor_name, (l_orderkey * 10 + l_linenumber) * 10000000 + l_suppkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
og AS (SELECT company_id, event_type, round_name, announce_date, count(*) AS n_participant_rows FROM pt GROUP BY ALL)"""
_KEYS = "company_id, event_type, round_name, announce_date"
_ORDERED = lambda c, name: f"(SELECT {_KEYS}, string_agg(v, ',' ORDER BY first) AS {name} FROM (SELECT {_KEYS}, {c} AS v, min(ord) AS first FROM pt WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY ALL)"
_SAME = lambda x: f"og.company_id = {x}.company_id AND og.event_type = {x}.event_type AND og.round_name IS NOT DISTINCT FROM {x}.round_name AND og.announce_date IS NOT DISTINCT FROM {x}.announce_date"
_TABLE = f"""{base._SUPPORT}, cmp AS (SELECT *, {" + ".join(f"n_{t}_episode_count" for t in behavior.GOVERNANCE)} AS n_governance_and_ownership_episode_count FROM sm WHERE passes_primary_episode_gate_3_3)"""


def supplier_medians(spark, sf_dir):
    """Median and quartiles of the prices of each supplier's line items."""
    return quantiles.medians(a.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"q1": 0.25, "q3": 0.75})


def quantity_histogram(spark, sf_dir):
    return quantiles.histogram(a.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 10)


QUERIES = {
    "supplier_medians": (supplier_medians, "SELECT l_suppkey, count(l_extendedprice) AS n, median(l_extendedprice) AS median, quantile_disc(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY l_suppkey"),
    "quantity_histogram": (quantity_histogram, "SELECT l_returnflag, floor(l_quantity / 10)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL"),
    "projected_scan": (projected_scan, "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, 0::BIGINT AS n_notes FROM lineitem GROUP BY l_returnflag"),
    "footer_counts": (footer_counts, " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM duckdb_columns() WHERE table_name = '{t}') AS columns" for t in ("customer", "documents", "lineitem", "orders", "pages"))),
    "tagged_sources": (tagged_sources, "SELECT 'customer' AS source, count(*) AS n, count(c_custkey) AS n_customers, 0::BIGINT AS n_suppliers FROM customer UNION ALL SELECT 'supplier', count(*), 0, count(s_suppkey) FROM supplier"),
    "outcome_groups": (outcome_groups, f"""WITH {_PARTS} SELECT og.*, coalesce(e.ids, '') AS outcome_event_ids, coalesce(i.ids, '') AS investor_ids, coalesce(r.ids, '') AS investor_raw_names FROM og LEFT JOIN {_ORDERED('event_id', 'ids')} e ON {_SAME('e')} LEFT JOIN {_ORDERED('investor_id', 'ids')} i ON {_SAME('i')} LEFT JOIN {_ORDERED('raw_investor_name', 'ids')} r ON {_SAME('r')}"""),
    "outcome_chains": (outcome_chains, f"""WITH {_PARTS}, d AS (SELECT *, (announce_date || '-01')::DATE AS "end" FROM og)
      SELECT {_KEYS}, row_number() OVER w AS chain_sequence, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start, "end", 'chain:' || substr(sha1(company_id || '|' || event_type || '|' || coalesce(round_name, '') || '|' || coalesce("end"::VARCHAR, 'unknown')), 1, 20) AS chain_id, n_participant_rows
      FROM d WINDOW w AS (PARTITION BY company_id ORDER BY "end" NULLS LAST, event_type, coalesce(round_name, ''))"""),
    "investor_match": (investor_match, """WITH iv AS (SELECT slug, arg_max(id, s_suppkey) AS id FROM (SELECT s_suppkey, 'i' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'beta ' || s_suppkey % 20 ELSE 'supplier-' || s_suppkey % 50 END AS slug FROM supplier) GROUP BY slug),
      c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'SUPPLIER  ' || c_custkey % 60 WHEN 1 THEN 'Beta ' || c_custkey % 25 || ' Capital, LLC' WHEN 2 THEN 'beta ' || c_custkey % 25 WHEN 3 THEN '' END AS raw,
        CASE c_custkey % 5 WHEN 0 THEN 'supplier-' || c_custkey % 60 END AS sl, CASE c_custkey % 5 WHEN 0 THEN 'supplier ' || c_custkey % 60 WHEN 1 THEN 'beta ' || c_custkey % 25 WHEN 2 THEN 'beta ' || c_custkey % 25 END AS nm FROM customer)
      SELECT c_custkey, raw AS raw_investor_name, coalesce(x.id, y.id) AS by_slug_then_name, y.id AS by_name FROM c LEFT JOIN iv x ON sl = x.slug LEFT JOIN iv y ON nm = y.slug"""),
    "event_rows": (event_rows, """WITH t AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS mo, strftime(o_orderdate, '%Y-%m-%d') AS dy FROM orders),
      e AS (SELECT *, ['funding_round', 'acquired', 'funding_failed', 'other'][k % 4 + 1] AS event_type FROM t)
      SELECT k AS o_orderkey, event_type, CASE k % 3 WHEN 1 THEN mo WHEN 2 THEN dy END AS event_date, CASE WHEN k % 5 > 1 THEN k END AS amount_usd, CASE WHEN k % 6 > 0 THEN (k % 10) / 10 ELSE 0.0 END AS confidence,
      CASE WHEN event_type LIKE 'funding%' THEN CASE WHEN k % 2 = 0 THEN 'Series A' ELSE 'unknown' END END AS round_name FROM e"""),
    "name_folding": (name_folding, """WITH p AS (SELECT p_partkey, p_partkey % 8 + 1 AS i, ' ' || p_partkey % 50 AS n FROM part)
      SELECT p_partkey, ['strasse', 'école saint-éloi', 'σοφοσ κόσμοσ', 'ｆｕｎｄ ａ', 'fine capital', 'plain name', 'æther holdings', 'škoda auto'][i] || n AS dedup,
      ['strasse', 'école saint éloi', 'σοφοσ κόσμοσ', 'ｆｕｎｄ ａ', 'fine capital', 'plain name', 'æther holdings', 'škoda auto'][i] || n AS exact,
      ['strasse', 'école saint-éloi', 'σοφοσ κόσμοσ', 'ｆｕｎｄ ａ', 'fine capital', 'plain name', 'æther holdings', 'škoda auto'][i] || n AS identity,
      ['strasse', 'école saint-éloi', 'σοφοσ κόσμοσ', 'fund a', 'fine capital', 'plain name', 'æther holdings', 'škoda auto'][i] || n AS compatible FROM p"""),
    "candidate_rankings": (candidate_rankings, f"""{_TABLE}, rk AS ({" UNION ALL ".join(f"SELECT '{k}' AS ranking, {c}::BIGINT AS value, investor_id, investor_name FROM cmp" for k, c in behavior.RANKINGS.items())})
      SELECT ranking, row_number() OVER (PARTITION BY ranking ORDER BY value DESC, investor_name, investor_id) AS candidate_rank, investor_id, investor_name, value, value = max(value) OVER (PARTITION BY ranking) AS leads FROM rk"""),
    "candidate_signatures": (candidate_signatures, f"""{_TABLE}, g AS (SELECT *, concat_ws('+', CASE WHEN n_exit_episode_count > 0 THEN 'exit' END, CASE WHEN n_strategic_investment_episode_count > 0 THEN 'strategic_investment' END, CASE WHEN n_governance_and_ownership_episode_count > 0 THEN 'governance_or_ownership' END) AS core_behavior_signature FROM cmp)
      SELECT core_behavior_signature, count(*) AS candidate_count, sum(n_core_episode_count)::BIGINT AS aggregate_core_episode_count, sum(n_exit_episode_count)::BIGINT AS aggregate_exit_episode_count, sum(n_strategic_investment_episode_count)::BIGINT AS aggregate_strategic_investment_episode_count,
      sum(n_governance_and_ownership_episode_count)::BIGINT AS aggregate_governance_and_ownership_episode_count, sum(n_funding_participation_rows)::BIGINT AS aggregate_funding_participation_rows, count(*) >= 2 AS repeated FROM g GROUP BY 1"""),
    "confirmed_distributions": (confirmed_distributions, f"""{base._RELATED}, p AS (SELECT investor_id, count(*) AS events, count(DISTINCT company_id) AS companies FROM rel WHERE st = 'CONFIRMED_POST_INVESTMENT' GROUP BY investor_id), m AS (SELECT 'events' AS measure, events AS v FROM p UNION ALL SELECT 'companies', companies FROM p)
      SELECT measure, min(v) AS minimum, median(v) AS median, avg(v) AS mean, max(v) AS maximum, count(*) AS investors FROM m GROUP BY measure"""),
    "investor_types": (investor_types, f"""{base._RELATED}, c AS (SELECT investor_id FROM rel WHERE st = 'CONFIRMED_POST_INVESTMENT'), t AS (SELECT s_suppkey AS investor_id, 'vc' AS investor_type FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'bank' FROM supplier WHERE s_suppkey % 3 = 0)
      SELECT investor_type, count(DISTINCT investor_id) AS investors, count(*) AS event_rows, count(*) / (SELECT count(*) FROM c) AS event_row_share FROM c JOIN t USING (investor_id) GROUP BY 1"""),
}
