"""Queries on dates, claims, chains, batches, history and behavior."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.functions import dates, names
from eventloom.operators import behavior, chains
from eventloom.plans import analogues as a

WITH = "WITH " + a.EVENTS_SQL


def _chains(spark, sf_dir):
    made = chains.sequence_outcomes(a.outcomes(spark, sf_dir))
    return made.select("company_id", "event_type", "round_name", "n_participant_rows", "end", "start", "chain_sequence", "chain_id")


def _middle(spark, sf_dir):
    """Exposure and interface events with the chain they fall into."""
    rows = a.events(spark, sf_dir).filter("family <> 'outcome'").select("company_id", "day", "event_id", "event_type", "family", "event_date")
    return chains.assign_events(_chains(spark, sf_dir), rows)


def chain_sequence(spark, sf_dir):
    return _chains(spark, sf_dir).select("company_id", "chain_sequence", "start", "end", "n_participant_rows", "chain_id")


def chain_windows(spark, sf_dir):
    counts = _middle(spark, sf_dir).groupBy("company_id", "chain_sequence").agg(*[F.count_if(F.col("family") == f).alias(f"n_{f}") for f in ("exposure", "interface")], F.count_distinct("event_type").alias("n_types"))
    out = _chains(spark, sf_dir).join(counts, ["company_id", "chain_sequence"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("company_id", "chain_sequence", "end", zero("n_exposure"), zero("n_interface"), zero("n_types"))


def chain_unassigned(spark, sf_dir):
    rows = a.events(spark, sf_dir).filter("family <> 'outcome'")
    left = rows.join(_middle(spark, sf_dir).select("event_id"), "event_id", "left_anti")
    return left.groupBy("family").agg(F.count(F.lit(1)).alias("n_unassigned"), F.count_distinct("company_id").alias("n_companies"))


def chain_tables(spark, sf_dir):
    rows = a.events(spark, sf_dir).withColumn("event_date", F.col("day").cast("string"))
    made = chains.build_chains(a.outcomes(spark, sf_dir), rows.filter("family = 'exposure'"), rows.filter("family = 'interface'"))
    return made.select("chain_id", "company_id", "chain_sequence", "chain_start_date", "chain_end_date", "chain_window_status", "n_exposure", "n_interface", F.array_join(F.array_sort("exposure_types"), ",").alias("exposure_types"), F.size("interface_event_ids").alias("n_interface_ids"))


def batch_islands(spark, sf_dir):
    rows = chains.with_interval(_middle(spark, sf_dir))
    return chains.batches(rows, "company_id", "chain_sequence").select("event_id", "company_id", "chain_sequence", "lo", "hi", "batch")


def batch_gaps(spark, sf_dir):
    rows = chains.with_interval(_middle(spark, sf_dir))
    return chains.batch_gaps(chains.batches(rows, "company_id", "chain_sequence"), "company_id", "chain_sequence")


def chain_signatures(spark, sf_dir):
    rows = chains.batches(chains.with_interval(_middle(spark, sf_dir)), "company_id", "chain_sequence")
    return chains.signatures(rows, "company_id", "chain_sequence")


def partial_date_intervals(spark, sf_dir):
    d = dates.partial_date(F.col("event_date"))
    return a.events(spark, sf_dir).select("event_id", d["lo"].alias("lo"), d["hi"].alias("hi"), d["precision"].alias("precision"))


def date_rules(spark, sf_dir):
    """Every rule on texts that aren't dates, too: the text is cut or prolonged by the event's number."""
    digit = F.col("event_id").cast("long") % 7
    text = F.when(digit == 0, F.concat("event_date", F.lit("-31"))).when(digit == 1, F.concat("event_date", F.lit("T00:00"))).when(digit == 2, F.lit("unknown")).when(digit == 3, F.substring("event_date", 1, 6)).otherwise(F.col("event_date"))
    rows = a.events(spark, sf_dir).select("event_id", text.alias("text"))
    return rows.select("event_id", "text", dates.partial_date(F.col("text"))["lo"].alias("loose"), dates.strict_partial_date(F.col("text"))["hi"].alias("strict"), dates.valid_partial_date(F.col("text")).alias("valid"), dates.boundary_date(F.col("text")).alias("boundary"), dates.leading_year(F.col("text")).alias("year"))


def _claims(spark, sf_dir):
    rows = a.events(spark, sf_dir)
    return rows.select(
        F.concat_ws("|", "company_id", "event_type", F.col("day").cast("string")).alias("event_id"),
        F.col("event_id").cast("long").alias("ord"),
        (F.col("event_id").cast("long") % 4 / 10).alias("confidence"),
        F.when(F.col("event_type") == "purchase", "funding_round").otherwise("acquisition").alias("event_type"),
        F.col("family").alias("source"),
        F.floor(F.col("value")).cast("long").alias("amount"),
    )


def claim_resolution(spark, sf_dir):
    made = chains.resolve_claims(_claims(spark, sf_dir), "ord", ["amount", "source"])
    return made.select("event_id", "ord", "confidence", "amount", "n_claims", "confidence_tied", F.array_join("conflict_fields", ",").alias("conflict_fields"))


def claim_lineage(spark, sf_dir):
    return chains.claim_lineage(_claims(spark, sf_dir), "ord").select("event_id", "ord", "claim_ordinal", "n_claims", "selected")


def claim_stats(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    return chains.claim_stats(claims, chains.resolve_claims(claims, "ord", ["amount", "source"]))


def participant_explode(spark, sf_dir):
    n = F.col("o_orderkey")
    claims = a.table(spark, sf_dir, "orders").select(
        n.alias("order_id"),
        F.when(n % 3 == 0, "acquired").when(n % 17 == 0, "ipo").when(n % 7 == 0, "funding_failed").otherwise("funding_round").alias("event_type"),
        F.when(n % 5 > 0, F.concat(F.lit(" Lead "), (n % 11).cast("string"))).alias("lead_investor"),
        F.when(n % 4 == 0, F.array(F.concat(F.lit("Co "), (n % 7).cast("string")), F.lit(" "), F.lit("Second"))).alias("co_investors"),
        F.when(n % 6 == 0, F.concat(F.lit("Buyer "), (n % 13).cast("string"))).alias("acquirer"),
    )
    return chains.participants(claims)


def event_hash_ids(spark, sf_dir):
    rows = a.events(spark, sf_dir)
    return rows.select("event_id", names.hash_id("fund", F.col("company_id"), F.col("event_type"), F.nullif(F.col("family"), F.lit("interface")), F.col("event_date")).alias("hash_id"), names.record_id("v1", F.col("event_id"), F.sha2("event_date", 256)).alias("record_id"))


def event_id_sets(spark, sf_dir):
    return a.events(spark, sf_dir).groupBy("company_id").agg(names.id_set_sha256(F.col("event_id")).alias("ids_sha256"), F.count_distinct("event_id").alias("n_ids"))


def history_features(spark, sf_dir):
    n = F.col("o_orderkey")
    spelt = F.when(n % 5 == 0, F.concat(F.lit("Series "), F.chr(F.lit(65) + n % 3), F.lit(" Round"))).when(n % 5 == 1, "Pre-Seed").when(n % 5 == 2, "unknown").when(n % 5 == 3, "Bridge financing").otherwise("Venture Debt")
    orders = a.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_id"),
        n.alias("chain_id"),
        spelt.alias("round_name"),
        F.to_date("o_orderdate").alias("end"),
        F.array((n % 3).cast("string"), (n % 4).cast("string")).alias("investor_keys"),
    )
    ordered = orders.withColumn("chain_sequence", F.row_number().over(Window.partitionBy("company_id").orderBy("end", "chain_id")))
    keep = ["chain_id", "chain_sequence", "outcome_round_bucket", "n_prior_chains", "company_chain_count", "is_last_chain", "chain_position_bucket", "prior_same_round_count", "round_occurrence_index", "days_since_previous_same_round", "prior_outcome_investor_overlap_count", "prior_outcome_investor_overlap_ratio"]
    return chains.history(ordered).select("company_id", *keep)


def _related(spark, sf_dir):
    evidence, moves = a.deals(spark, sf_dir)
    return behavior.relate(moves, behavior.pair_bounds(evidence))


def temporal_relation(spark, sf_dir):
    return _related(spark, sf_dir).groupBy("investor_id", "temporal_relation_status").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("company_id").alias("n_companies"), F.sum("n_evidence").alias("n_evidence"))


def investor_profiles(spark, sf_dir):
    return behavior.profiles(_related(spark, sf_dir))


def _support(spark, sf_dir, ranked=False):
    _, moves = a.deals(spark, sf_dir)
    return behavior.support(moves.withColumn("investor_name", F.concat(F.lit("S"), F.col("investor_id").cast("string"))), ranked)


def investor_support(spark, sf_dir):
    return _support(spark, sf_dir, ranked=True)


def support_grid(spark, sf_dir):
    return behavior.threshold_grid(_support(spark, sf_dir))


def duplicate_sensitive(spark, sf_dir):
    rows = a.table(spark, sf_dir, "events")
    made = rows.select(F.col("user_id").alias("investor_id"), F.col("user_id").cast("string").alias("investor_name"), (F.col("event_id") % 5).alias("company_id"), "event_id", F.when(F.col("event_type") == "purchase", "exit").otherwise("other").alias("event_type"), F.date_format("ts", "yyyy").alias("event_date"))
    return behavior.duplicate_sensitive(behavior.support(made, ranked=False))


def behavior_combinations(spark, sf_dir):
    _, moves = a.deals(spark, sf_dir)
    return behavior.behavior_combinations(moves)


def candidate_comparison(spark, sf_dir):
    return behavior.compare_candidates(_support(spark, sf_dir))


_MIDDLE = f"""{WITH}, {a.OUTCOMES_SQL}, {a.CHAINS_SQL}, {a.INTERVALS_SQL},
mid AS (SELECT iv.*, ch.chain_sequence FROM iv JOIN ch ON iv.company_id = ch.company_id AND iv.day < ch.end_day AND (ch.start_day IS NULL OR iv.day >= ch.start_day) WHERE family <> 'outcome'),
bt AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, chain_sequence ORDER BY lo, hi, family, event_type, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS batch
  FROM (SELECT *, max(hi) OVER (PARTITION BY company_id, chain_sequence ORDER BY lo, hi, family, event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mid))"""
_CHAIN_ID = "'chain:' || substr(sha1(company_id || '|' || event_type || '||' || end_day), 1, 20)"
_RELATED = f"""WITH {a.DEALS_SQL},
pr AS (SELECT mv.*, count(evd.lo) AS n_evidence, count(*) FILTER (evd.hi < mv.lo) AS n_before, count(*) FILTER (evd.lo <= mv.hi AND evd.hi >= mv.lo) AS n_over
  FROM (SELECT row_number() OVER () AS rn, * FROM mv) mv LEFT JOIN evd USING (investor_id, company_id) GROUP BY ALL),
rel AS (SELECT *, CASE WHEN n_evidence = 0 THEN 'NO_INVESTMENT_EVIDENCE' WHEN n_before > 0 THEN 'CONFIRMED_POST_INVESTMENT' WHEN n_over > 0 THEN 'SAME_OR_OVERLAPPING_INVESTMENT_DATE' ELSE 'INVESTMENT_EVIDENCE_ONLY_AFTER_EVENT' END AS st FROM pr)"""
_CORE = ", ".join(f"'{t}'" for t in behavior.CORE)
_SUPPORT = f"""WITH {a.DEALS_SQL}, r AS (SELECT *, event_type IN ({_CORE}) AS core, company_id || '|' || event_type || '|' || event_date AS ep FROM mv),
m AS (SELECT investor_id, 'S' || investor_id AS investor_name, count(*) AS n_interface_event_rows, count(DISTINCT company_id) AS n_all_interface_companies,
  count(*) FILTER (core) AS n_core_event_rows, count(DISTINCT ep) FILTER (core) AS n_core_episode_count, count(DISTINCT company_id) FILTER (core) AS n_core_companies,
  count(*) FILTER (event_type = 'funding_participation') AS n_funding_participation_rows, count(*) FILTER (event_type = 'exit') AS n_exit_event_rows,
  {", ".join(f"count(DISTINCT ep) FILTER (event_type = '{t}') AS n_{t}_episode_count" for t in behavior.CORE)} FROM r GROUP BY investor_id),
fe AS (SELECT investor_id, count(*) FILTER (f AND x) AS n_funding_to_exit_companies FROM (SELECT investor_id, company_id, bool_or(event_type = 'funding_participation') AS f, bool_or(event_type = 'exit') AS x FROM r GROUP BY ALL) GROUP BY investor_id),
sm AS (SELECT m.*, fe.n_funding_to_exit_companies, n_core_event_rows - n_core_episode_count AS n_duplicate_core_source_rows,
  CASE WHEN n_core_episode_count > 0 THEN n_exit_episode_count / n_core_episode_count END AS exit_share_of_core_episodes,
  n_core_episode_count >= 3 AND n_all_interface_companies >= 3 AS passes_primary_episode_gate_3_3,
  n_core_event_rows >= 5 AND n_all_interface_companies >= 3 AS passes_legacy_raw_gate_5_3,
  n_core_episode_count >= 5 AND n_all_interface_companies >= 3 AS passes_legacy_episode_gate_5_3,
  row_number() OVER (ORDER BY n_all_interface_companies DESC, n_core_episode_count DESC, investor_name, investor_id) AS breadth_rank_by_all_interface_companies,
  row_number() OVER (ORDER BY n_core_episode_count DESC, n_all_interface_companies DESC, investor_name, investor_id) AS core_episode_count_rank FROM m JOIN fe USING (investor_id))"""


def _json_counts(name, value, where="true"):
    return f"(SELECT investor_id, '{{' || string_agg('\"' || v || '\":' || n, ',' ORDER BY v) || '}}' AS {name} FROM (SELECT investor_id, {value} AS v, count(*) AS n FROM rel WHERE {where} GROUP BY ALL) GROUP BY investor_id)"


QUERIES = {
    "chain_sequence": (chain_sequence, f'{WITH}, {a.OUTCOMES_SQL}, {a.CHAINS_SQL} SELECT company_id, chain_sequence, start_day AS start, end_day AS "end", n_participant_rows, {_CHAIN_ID} AS chain_id FROM ch'),
    "chain_windows": (chain_windows, f"""{_MIDDLE} SELECT ch.company_id, ch.chain_sequence, ch.end_day AS "end", count(*) FILTER (family = 'exposure') AS n_exposure, count(*) FILTER (family = 'interface') AS n_interface,
      count(DISTINCT mid.event_type) AS n_types FROM ch LEFT JOIN mid USING (company_id, chain_sequence) GROUP BY ALL"""),
    "chain_unassigned": (chain_unassigned, f"{_MIDDLE} SELECT family, count(*) AS n_unassigned, count(DISTINCT company_id) AS n_companies FROM ev WHERE family <> 'outcome' AND event_id NOT IN (SELECT event_id FROM mid) GROUP BY family"),
    "chain_tables": (chain_tables, f"""{_MIDDLE} SELECT {_CHAIN_ID.replace('company_id', 'ch.company_id').replace('event_type', 'ch.event_type')} AS chain_id, ch.company_id, ch.chain_sequence, coalesce(start_day::VARCHAR, 'founding') AS chain_start_date, end_day::VARCHAR AS chain_end_date,
      'dated' AS chain_window_status, count(*) FILTER (family = 'exposure') AS n_exposure, count(*) FILTER (family = 'interface') AS n_interface,
      coalesce(string_agg(DISTINCT mid.event_type, ',' ORDER BY mid.event_type) FILTER (family = 'exposure'), '') AS exposure_types, (count(*) FILTER (family = 'interface'))::INT AS n_interface_ids
      FROM ch LEFT JOIN mid USING (company_id, chain_sequence) GROUP BY ALL"""),
    "batch_islands": (batch_islands, f"{_MIDDLE} SELECT event_id, company_id, chain_sequence, lo, hi, batch FROM bt"),
    "batch_gaps": (batch_gaps, f"""{_MIDDLE}, b AS (SELECT company_id, chain_sequence, batch, min(lo) AS lo, max(hi) AS hi FROM bt GROUP BY ALL),
      g AS (SELECT *, lo - lag(hi) OVER w AS g_min, hi - lag(lo) OVER w AS g_max FROM b WINDOW w AS (PARTITION BY company_id, chain_sequence ORDER BY batch))
      SELECT company_id, chain_sequence, count(*) AS n_ordered_batches, count(*) - 1 AS n_comparable_gaps,
      CASE WHEN count(*) > 1 THEN (max_by(lo, batch) - min_by(hi, batch))::INT END AS middle_span_min, CASE WHEN count(*) > 1 THEN (max_by(hi, batch) - min_by(lo, batch))::INT END AS middle_span_max,
      min(g_min)::INT AS min_interbatch_gap_min, min(g_max)::INT AS min_interbatch_gap_max, max(g_min)::INT AS max_interbatch_gap_min, max(g_max)::INT AS max_interbatch_gap_max FROM g GROUP BY ALL"""),
    "chain_signatures": (chain_signatures, f"""{_MIDDLE}, t AS (SELECT company_id, chain_sequence, batch, count(*) AS n, '{{' || string_agg(upper(family[1]) || ':' || event_type, '|' ORDER BY family, event_type, event_id) || '}}' AS part FROM bt GROUP BY ALL)
      SELECT company_id, chain_sequence, sum(n)::INT AS n_middle, string_agg(part, '>' ORDER BY batch) AS signature FROM t GROUP BY ALL"""),
    "partial_date_intervals": (partial_date_intervals, f"{WITH}, {a.INTERVALS_SQL} SELECT event_id, lo, hi, CASE length(event_date) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS precision FROM iv"),
    "date_rules": (date_rules, rf"""{WITH}, t AS (SELECT event_id, CASE event_id::BIGINT % 7 WHEN 0 THEN event_date || '-31' WHEN 1 THEN event_date || 'T00:00' WHEN 2 THEN 'unknown' WHEN 3 THEN substr(event_date, 1, 6) ELSE event_date END AS text FROM ev),
      u AS (SELECT *, CASE WHEN regexp_full_match(text, '\d{{4}}') THEN 'y' WHEN regexp_full_match(text, '\d{{4}}-\d{{2}}') THEN 'm' WHEN regexp_matches(text, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN 'd' END AS k, regexp_full_match(text, '\d{{4}}-\d{{2}}-\d{{2}}') AS whole FROM t),
      v AS (SELECT *, CASE k WHEN 'y' THEN try_cast(text || '-01-01' AS DATE) WHEN 'm' THEN try_cast(text || '-01' AS DATE) WHEN 'd' THEN try_cast(substr(text, 1, 10) AS DATE) END AS lo FROM u),
      w AS (SELECT *, CASE k WHEN 'y' THEN try_cast(text || '-12-31' AS DATE) WHEN 'm' THEN last_day(lo) WHEN 'd' THEN CASE WHEN whole THEN lo END END AS strict FROM v)
      SELECT event_id, text, lo AS loose, strict, CASE WHEN strict IS NOT NULL THEN text END AS valid,
      CASE WHEN substr(text, 1, 10) IN ('unknown', 'nan', 'None', '') THEN NULL ELSE coalesce(CASE WHEN regexp_full_match(substr(text, 1, 10), '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(substr(text, 1, 10) AS DATE) END,
        CASE WHEN regexp_full_match(substr(text, 1, 10), '\d{{4}}-\d{{2}}') THEN try_cast(substr(text, 1, 10) || '-01' AS DATE) END, CASE WHEN regexp_full_match(substr(text, 1, 10), '\d{{4}}') THEN try_cast(substr(text, 1, 10) || '-01-01' AS DATE) END) END AS boundary,
      try_cast(substr(trim(text), 1, 4) AS INT) AS year FROM w"""),
    "claim_resolution": (claim_resolution, f"""{WITH}, c AS (SELECT company_id || '|' || event_type || '|' || day AS event_id, event_id::BIGINT AS ord, event_id::BIGINT % 4 / 10 AS confidence, family AS source, floor(value)::BIGINT AS amount FROM ev)
      SELECT event_id, arg_min(ord, (-confidence, ord)) AS ord, max(confidence) AS confidence, arg_min(amount, (-confidence, ord)) AS amount, count(*) AS n_claims,
      count(*) FILTER (confidence = top) > 1 AS confidence_tied, concat_ws(',', CASE WHEN count(DISTINCT amount) > 1 THEN 'amount' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END) AS conflict_fields
      FROM (SELECT *, max(confidence) OVER (PARTITION BY event_id) AS top FROM c) GROUP BY event_id"""),
    "claim_lineage": (claim_lineage, f"""{WITH}, c AS (SELECT company_id || '|' || event_type || '|' || day AS event_id, event_id::BIGINT AS ord, event_id::BIGINT % 4 / 10 AS confidence FROM ev)
      SELECT event_id, ord, row_number() OVER (PARTITION BY event_id ORDER BY ord) AS claim_ordinal, count(*) OVER (PARTITION BY event_id) AS n_claims, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, ord) = 1 AS selected FROM c QUALIFY n_claims > 1"""),
    "claim_stats": (claim_stats, f"""{WITH}, c AS (SELECT company_id || '|' || event_type || '|' || day AS event_id, event_id::BIGINT % 4 / 10 AS confidence, family AS source, floor(value)::BIGINT AS amount FROM ev),
      g AS (SELECT event_id, count(*) AS n, count(*) FILTER (confidence = top) > 1 AS tied, count(DISTINCT amount) > 1 OR count(DISTINCT source) > 1 AS differ FROM (SELECT *, max(confidence) OVER (PARTITION BY event_id) AS top FROM c) GROUP BY event_id)
      SELECT count(*) AS output_rows, count(*) FILTER (n > 1) AS collision_groups, sum(n - 1)::BIGINT AS claims_collapsed, count(*) FILTER (n > 1 AND NOT tied) AS unique_highest_confidence_groups, count(*) FILTER (n > 1 AND tied) AS tied_highest_confidence_groups,
      count(*) FILTER (n > 1 AND differ) AS semantic_conflict_groups, sum(n)::BIGINT AS input_rows FROM g"""),
    "participant_explode": (participant_explode, """WITH c AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'acquired' WHEN o_orderkey % 17 = 0 THEN 'ipo' WHEN o_orderkey % 7 = 0 THEN 'funding_failed' ELSE 'funding_round' END AS event_type,
        CASE WHEN o_orderkey % 5 > 0 THEN ' Lead ' || o_orderkey % 11 END AS lead, CASE WHEN o_orderkey % 4 = 0 THEN 'Co ' || o_orderkey % 7 END AS co, CASE WHEN o_orderkey % 6 = 0 THEN 'Buyer ' || o_orderkey % 13 END AS buyer FROM orders),
      p AS (SELECT order_id, event_type, lead AS investor_name, 'lead' AS role FROM c WHERE event_type LIKE 'funding%' AND lead IS NOT NULL
        UNION ALL SELECT order_id, event_type, x, 'co' FROM c, (VALUES (1), (2), (3)) v(k), LATERAL (SELECT CASE k WHEN 1 THEN co WHEN 2 THEN ' ' ELSE 'Second' END AS x) WHERE event_type LIKE 'funding%' AND co IS NOT NULL
        UNION ALL SELECT order_id, event_type, buyer, 'acquirer' FROM c WHERE event_type = 'acquired')
      SELECT * FROM p UNION ALL SELECT order_id, event_type, NULL, 'unknown' FROM c WHERE order_id NOT IN (SELECT order_id FROM p)"""),
    "event_hash_ids": (event_hash_ids, f"""{WITH} SELECT event_id, 'fund:' || substr(sha1(company_id || '|' || event_type || '|' || CASE WHEN family = 'interface' THEN '' ELSE family END || '|' || event_date), 1, 20) AS hash_id,
      'irn:' || substr(sha256('v1' || chr(0) || event_id || chr(0) || sha256(event_date)), 1, 24) AS record_id FROM ev"""),
    "event_id_sets": (event_id_sets, f"{WITH} SELECT company_id, sha256(string_agg(event_id, chr(10) ORDER BY event_id)) AS ids_sha256, count(DISTINCT event_id) AS n_ids FROM ev GROUP BY company_id"),
    "history_features": (history_features, """WITH o AS (SELECT o_custkey AS company_id, o_orderkey AS chain_id, CASE o_orderkey % 5 WHEN 0 THEN 'series_' || chr((97 + o_orderkey % 3)::INT) WHEN 1 THEN 'pre_seed' WHEN 2 THEN 'unknown' WHEN 3 THEN 'bridge_or_extension' ELSE 'debt' END AS b,
        o_orderdate::DATE AS end_day, [(o_orderkey % 3)::VARCHAR, (o_orderkey % 4)::VARCHAR] AS keys FROM orders),
      s AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY end_day, chain_id) AS n, count(*) OVER (PARTITION BY company_id) AS total FROM o),
      h AS (SELECT *, CASE WHEN b = 'unknown' THEN 0 ELSE row_number() OVER same - 1 END AS before, CASE WHEN b <> 'unknown' THEN end_day - lag(end_day) OVER same END AS days,
        flatten(list(keys) OVER (PARTITION BY company_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen FROM s WINDOW same AS (PARTITION BY company_id, b ORDER BY n)),
      x AS (SELECT *, len(list_distinct(list_intersect(keys, coalesce(seen, [])))) AS shared, len(list_distinct(keys)) AS own FROM h)
      SELECT company_id, chain_id, n::INT AS chain_sequence, b AS outcome_round_bucket, n - 1 AS n_prior_chains, total AS company_chain_count, n = total AS is_last_chain,
      CASE WHEN n = 1 THEN 'first' WHEN n = total THEN 'last' WHEN n <= 3 THEN 'early' ELSE 'later' END AS chain_position_bucket, before AS prior_same_round_count, before + 1 AS round_occurrence_index,
      days::INT AS days_since_previous_same_round, shared AS prior_outcome_investor_overlap_count, shared / own AS prior_outcome_investor_overlap_ratio FROM x"""),
    "temporal_relation": (temporal_relation, f"{_RELATED} SELECT investor_id, st AS temporal_relation_status, count(*) AS n_rows, count(DISTINCT company_id) AS n_companies, sum(n_evidence)::BIGINT AS n_evidence FROM rel GROUP BY ALL"),
    "investor_profiles": (investor_profiles, f"""{_RELATED}, pc AS (SELECT investor_id, company_id, count(*) AS n, arg_max(company_label, event_id) AS label, bool_or(st = 'CONFIRMED_POST_INVESTMENT') AS c FROM rel GROUP BY ALL),
      co AS (SELECT investor_id, count(*) AS n_interface_companies, count(*) FILTER (n >= 2) AS n_repeated_interface_companies, max(n) AS max_event_rows_per_company, count(*) FILTER (c) AS n_confirmed_post_investment_companies,
        {", ".join(f"count(*) FILTER (label = '{x}') AS n_{x.lower()}_companies, count(*) FILTER (label = '{x}' AND c) AS n_confirmed_post_{x.lower()}_companies" for x in ("SUCCESS", "FAILURE", "AMBIGUOUS"))} FROM pc GROUP BY investor_id),
      ro AS (SELECT investor_id, count(*) AS n_interface_event_rows, count(DISTINCT event_type) AS n_distinct_event_types, count(*) AS n_dated_event_rows, min(event_date) AS first_interface_event_date, max(event_date) AS last_interface_event_date,
        count(*) FILTER (st = 'CONFIRMED_POST_INVESTMENT') AS n_confirmed_post_investment_rows, count(DISTINCT company_id || '|' || event_type || '|' || event_date) FILTER (st = 'CONFIRMED_POST_INVESTMENT') AS n_confirmed_post_investment_episode_keys,
        count(*) FILTER (st = 'SAME_OR_OVERLAPPING_INVESTMENT_DATE') AS n_same_or_overlapping_investment_date_rows, count(*) FILTER (st = 'INVESTMENT_EVIDENCE_ONLY_AFTER_EVENT') AS n_investment_evidence_only_after_event_rows,
        count(*) FILTER (st = 'TIMING_UNKNOWN') AS n_timing_unknown_rows, count(*) FILTER (st = 'NO_INVESTMENT_EVIDENCE') AS n_no_investment_evidence_rows FROM rel GROUP BY investor_id)
      SELECT ro.*, co.* EXCLUDE (investor_id), n_confirmed_post_investment_rows - n_confirmed_post_investment_episode_keys AS n_confirmed_post_investment_duplicate_source_rows,
        coalesce(j1.event_type_counts_json, '{{}}') AS event_type_counts_json, coalesce(j2.confirmed_post_event_type_counts_json, '{{}}') AS confirmed_post_event_type_counts_json, j3.temporal_relation_status_counts_json
      FROM ro JOIN co USING (investor_id) LEFT JOIN {_json_counts('event_type_counts_json', 'event_type')} j1 USING (investor_id)
      LEFT JOIN {_json_counts('confirmed_post_event_type_counts_json', 'event_type', "st = 'CONFIRMED_POST_INVESTMENT'")} j2 USING (investor_id) LEFT JOIN {_json_counts('temporal_relation_status_counts_json', 'st')} j3 USING (investor_id)"""),
    "investor_support": (investor_support, f"{_SUPPORT} SELECT * FROM sm"),
    "support_grid": (support_grid, f"{_SUPPORT} SELECT e AS minimum_core_episode_count, c AS minimum_all_interface_companies, count(*) AS investor_count FROM sm, LATERAL (SELECT unnest(range(1, n_core_episode_count + 1)) AS e), LATERAL (SELECT unnest(range(1, n_all_interface_companies + 1)) AS c) GROUP BY ALL"),
    "duplicate_sensitive": (duplicate_sensitive, """SELECT investor_id FROM (SELECT user_id AS investor_id, count(*) FILTER (event_type = 'purchase') AS raw, count(DISTINCT (event_id % 5, year(ts))) FILTER (event_type = 'purchase') AS ep, count(DISTINCT event_id % 5) AS companies
      FROM events GROUP BY user_id) WHERE raw >= 5 AND companies >= 3 AND ep < 5"""),
    "behavior_combinations": (behavior_combinations, f"WITH {a.DEALS_SQL} SELECT combination, count(*) AS n_pairs FROM (SELECT investor_id, company_id, coalesce(string_agg(DISTINCT event_type, '+' ORDER BY event_type) FILTER (event_type IN ({_CORE})), '') AS combination FROM mv GROUP BY ALL) GROUP BY combination"),
    "candidate_comparison": (candidate_comparison, f"""{_SUPPORT}, g AS (SELECT *, concat_ws('+', {", ".join(f"CASE WHEN n_{t}_episode_count > 0 THEN '{t}' END" for t in behavior.CORE)}) AS signature FROM sm WHERE passes_primary_episode_gate_3_3)
      SELECT signature, count(*) AS n_investors, sum(n_core_episode_count)::BIGINT AS n_core_episodes, sum(n_all_interface_companies)::BIGINT AS n_companies, arg_min(investor_id, (-n_core_episode_count, -n_all_interface_companies, investor_name, investor_id)) AS leader FROM g GROUP BY signature"""),
}
