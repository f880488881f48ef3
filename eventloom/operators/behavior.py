"""Interface events against investment evidence: relations in time, profiles, gates and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.dates import strict_partial_date
from eventloom.operators.storage import global_rank, written

#: The event types that make a case, and the gates (episodes or rows, companies).
CORE = ("activist_action", "board_change", "exit", "major_holder_change", "secondary_transaction", "strategic_investment")
PRIMARY_GATE, LEGACY_GATE = (3, 3), (5, 3)
#: Types as bits, the one that isn't core first.
KINDS = ("funding_participation", *CORE)
CONFIRMED, OVERLAPPING, AFTER, UNKNOWN, NONE = "CONFIRMED_POST_INVESTMENT", "SAME_OR_OVERLAPPING_INVESTMENT_DATE", "INVESTMENT_EVIDENCE_ONLY_AFTER_EVENT", "TIMING_UNKNOWN", "NO_INVESTMENT_EVIDENCE"


def evidence(funding: DataFrame, interface: DataFrame) -> DataFrame:
    """(investor_id, company_id, lo, hi): one row per piece of evidence, dated or not; rows without an investor are left out."""
    parts = [funding.select("investor_id", "company_id", F.col("announce_date").alias("date")), interface.filter(F.col("event_type") == "funding_participation").select("investor_id", "company_id", F.col("event_date").alias("date"))]
    rows = parts[0].unionByName(parts[1]).filter(F.col("investor_id").isNotNull() & (F.col("investor_id") != ""))
    return rows.withColumn("d", strict_partial_date(F.col("date"))).select("investor_id", "company_id", F.col("d.lo").alias("lo"), F.col("d.hi").alias("hi"))


def pair_bounds(evidence_rows: DataFrame) -> DataFrame:
    """Per pair what the relation needs: the number of pieces and of dated ones, the earliest end, and the dated intervals.

    The intervals are merged where they overlap, so a pair with very much evidence stays small.
    """
    keys = ["investor_id", "company_id"]
    in_order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    dated = evidence_rows.filter(F.col("lo").isNotNull()).distinct().withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    merged = dated.withColumn("island", F.sum("new").over(in_order)).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    counts = evidence_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_evidence"), F.count("lo").alias("n_dated"), F.min("hi").alias("first_hi"))
    return counts.join(spans, keys, "left")


def temporal_relation(lo: Column, hi: Column) -> Column:
    """The relation of an event's interval to the pair's evidence (n_evidence, n_dated, first_hi, spans)."""
    overlap = F.exists("spans", lambda s: (s["lo"] <= hi) & (s["hi"] >= lo))
    return (
        F.when(F.col("n_evidence").isNull(), NONE)
        .when(lo.isNull() | (F.col("n_dated") == 0), UNKNOWN)
        .when(F.col("first_hi") < lo, CONFIRMED)
        .when(overlap, OVERLAPPING)
        .when(F.col("n_dated") == F.col("n_evidence"), AFTER)
        .otherwise(UNKNOWN)
    )


def relate(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds temporal_relation_status and the number of pieces of evidence to the events (investor_id, company_id, event_date)."""
    joined = events.withColumn("_d", strict_partial_date(F.col("event_date"))).join(bounds, ["investor_id", "company_id"], "left")
    out = joined.withColumn("temporal_relation_status", temporal_relation(F.col("_d.lo"), F.col("_d.hi")))
    return out.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))).drop("_d", "spans", "first_hi", "n_dated")


def episode() -> Column:
    """Rows of one episode share this key: company, type and date, or the row itself without a date."""
    day = F.nullif(F.col("event_date"), F.lit(""))
    return F.when(day.isNotNull(), F.concat_ws("|", "company_id", "event_type", day)).otherwise(F.concat(F.lit("event|"), "event_id"))


def counts_json(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, JSON object of how often each value occurs, in the order of the values)."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), "n")))
    return n.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias(name))


def _date_text(number: Column) -> Column:
    """The partial date (year, month or day) of eight digits whose missing parts are zeros."""
    digits = F.lpad(number.cast("string"), 8, "0")
    year, month, day = F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    return F.when(number.isNotNull(), F.concat_ws("-", year, F.nullif(month, F.lit("00")), F.nullif(day, F.lit("00"))))


def profiles(related: DataFrame) -> DataFrame:
    """One row per investor: rows, companies, types, dates, repeated companies, relations, episodes and labels.

    related: investor_id, company_id, company_label, event_id, event_type, event_date, temporal_relation_status.
    """
    # Several aggregates read these rows; the join behind them is made once.
    related = written(related.select("investor_id", "company_id", "company_label", "event_id", "event_type", "event_date", "temporal_relation_status"))
    status = F.col("temporal_relation_status")
    confirmed = status == CONFIRMED
    # A date as a number that keeps the order of its text: least and greatest texts would sort all rows, numbers are hashed.
    dated = F.when(strict_partial_date(F.col("event_date")).isNotNull(), F.rpad(F.replace(F.col("event_date"), F.lit("-"), F.lit("")), 8, "0").cast("int"))
    per_company = related.groupBy("investor_id", "company_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("company_label", "event_id").alias("label"), F.bool_or(confirmed).alias("confirmed")
    )
    label = F.when(F.col("label").isin("SUCCESS", "FAILURE"), F.col("label")).otherwise("AMBIGUOUS")
    companies = per_company.groupBy("investor_id").agg(
        F.count(F.lit(1)).alias("n_interface_companies"),
        F.count_if(F.col("n") >= 2).alias("n_repeated_interface_companies"),
        F.max("n").alias("max_event_rows_per_company"),
        F.count_if("confirmed").alias("n_confirmed_post_investment_companies"),
        *[F.count_if(label == x).alias(f"n_{x.lower()}_companies") for x in ("SUCCESS", "FAILURE", "AMBIGUOUS")],
        *[F.count_if((label == x) & F.col("confirmed")).alias(f"n_confirmed_post_{x.lower()}_companies") for x in ("SUCCESS", "FAILURE", "AMBIGUOUS")],
    )
    rows = related.withColumns({"_episode": F.when(confirmed, episode()), "_dated": dated}).groupBy("investor_id").agg(
        F.count(F.lit(1)).alias("n_interface_event_rows"),
        F.count("_dated").alias("n_dated_event_rows"),
        _date_text(F.min("_dated")).alias("first_interface_event_date"),
        _date_text(F.max("_dated")).alias("last_interface_event_date"),
        F.count_if(confirmed).alias("n_confirmed_post_investment_rows"),
        F.count_distinct("_episode").alias("n_confirmed_post_investment_episode_keys"),
        F.count_if(status == OVERLAPPING).alias("n_same_or_overlapping_investment_date_rows"),
        F.count_if(status == AFTER).alias("n_investment_evidence_only_after_event_rows"),
        F.count_if(status == UNKNOWN).alias("n_timing_unknown_rows"),
        F.count_if(status == NONE).alias("n_no_investment_evidence_rows"),
    )
    # Types are few: counted from the groups that the JSON text of their counts reads, too.
    types = related.groupBy("investor_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("investor_id").agg(F.count("event_type").alias("n_distinct_event_types"))
    rows = rows.join(types, "investor_id").select(*rows.columns[:2], "n_distinct_event_types", *rows.columns[2:])
    duplicate = F.col("n_confirmed_post_investment_rows") - F.col("n_confirmed_post_investment_episode_keys")
    out = rows.join(companies, "investor_id").withColumn("n_confirmed_post_investment_duplicate_source_rows", duplicate)
    for value, name, only in (
        ("event_type", "event_type_counts_json", None),
        ("event_type", "confirmed_post_event_type_counts_json", confirmed),
        ("temporal_relation_status", "temporal_relation_status_counts_json", None),
    ):
        out = out.join(counts_json(related if only is None else related.filter(only), "investor_id", value, name), "investor_id", "left").withColumn(name, F.coalesce(name, F.lit("{}")))
    return out


def support(events: DataFrame, ranked: bool = True) -> DataFrame:
    """One row per investor: core rows and episodes by type, companies, funding-to-exit companies, gates and, if asked for, two ranks.

    events: investor_id, investor_name, company_id, event_id, event_type, event_date.
    """
    # Two narrow rows an event: one counts it at its company, one is its episode, if it has one. A distinct count for each
    # type would make ten of each event. Names and kinds are keys, so that all that is summed is numbers.
    kind = reduce(lambda rest, k: F.when(F.col("event_type") == KINDS[k], 1 << k).otherwise(rest), range(len(KINDS)), F.lit(0))
    held = events.filter(F.col("investor_id").isNotNull()).select("investor_id", "investor_name", "company_id", kind.alias("_kind"), F.when(F.col("event_type").isin(*CORE), episode()).alias("_episode"))
    sides = F.when(F.col("_episode").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    of_company = lambda c: F.when(~F.col("_side"), F.col(c)).alias(c)
    of_episode = lambda c: F.when(F.col("_side"), F.col(c))
    rows = held.withColumn("_side", F.explode(sides)).select("investor_id", of_company("investor_name"), of_company("company_id"), of_company("_kind"), of_episode("_episode").alias("_episode"), of_episode("_kind").alias("_types"))
    cells = rows.groupBy("investor_id", "investor_name", "company_id", "_kind", "_episode").agg(F.count(F.lit(1)).alias("n"), F.bit_or("_types").alias("_types"))
    company = F.col("_kind").isNotNull()
    has = lambda c, t: F.col(c).bitwiseAND(1 << KINDS.index(t)) > 0
    counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = {
        "n_interface_event_rows": counted(company),
        "n_core_event_rows": counted(F.col("_kind") > 1),
        "n_core_episode_count": F.count("_episode"),
        "n_funding_participation_rows": counted(has("_kind", "funding_participation")),
        "n_exit_event_rows": counted(has("_kind", "exit")),
        **{f"n_{t}_episode_count": F.count_if(has("_types", t)) for t in CORE},
    }
    named = cells.groupBy("investor_id", "investor_name", "company_id", company.alias("_company")).agg(F.bit_or("_kind").alias("_kinds"), *[x.alias(k) for k, x in sums.items()])
    per_company = named.groupBy("investor_id", "company_id", "_company").agg(F.min("investor_name").alias("investor_name"), F.bit_or("_kinds").alias("_kinds"), *[F.sum(k).alias(k) for k in sums])
    known = F.col("company_id").isNotNull()
    companies = {
        "n_all_interface_companies": known,
        "n_core_companies": known & (F.col("_kinds") > 1),
        "n_funding_to_exit_companies": has("_kinds", "funding_participation") & has("_kinds", "exit"),
    }
    out = per_company.groupBy("investor_id").agg(F.min("investor_name").alias("investor_name"), *[F.sum(k).alias(k) for k in sums], *[F.count_if(test).alias(k) for k, test in companies.items()])
    order = ["n_interface_event_rows", "n_all_interface_companies", "n_core_event_rows", "n_core_episode_count", "n_core_companies", "n_funding_participation_rows", "n_exit_event_rows", *[f"n_{t}_episode_count" for t in CORE], "n_funding_to_exit_companies"]
    out = out.select("investor_id", "investor_name", *order)
    episodes, companies, raw = F.col("n_core_episode_count"), F.col("n_all_interface_companies"), F.col("n_core_event_rows")
    out = out.withColumns(
        {
            "n_duplicate_core_source_rows": raw - episodes,
            "exit_share_of_core_episodes": F.when(episodes > 0, F.col("n_exit_episode_count") / episodes),
            "passes_primary_episode_gate_3_3": (episodes >= PRIMARY_GATE[0]) & (companies >= PRIMARY_GATE[1]),
            "passes_legacy_raw_gate_5_3": (raw >= LEGACY_GATE[0]) & (companies >= LEGACY_GATE[1]),
            "passes_legacy_episode_gate_5_3": (episodes >= LEGACY_GATE[0]) & (companies >= LEGACY_GATE[1]),
        }
    )
    if not ranked:
        return out
    out = global_rank(out, "breadth_rank_by_all_interface_companies", -companies, -episodes, F.col("investor_name"), F.col("investor_id"))
    return global_rank(out, "core_episode_count_rank", -episodes, -companies, F.col("investor_name"), F.col("investor_id"))


def _at_least(cells: DataFrame, number: str, *others: str) -> DataFrame:
    """Sums of n over all rows of a group whose number is as large or larger."""
    down = Window.partitionBy(*others).orderBy(F.col(number).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("n", F.sum("n").over(down))


def _steps(cells: DataFrame, number: str) -> DataFrame:
    """The values of a number that occur, in order: place (from 1), the value, and the least number that counts as it."""
    values = global_rank(cells.select(number).distinct(), "place", F.col(number))
    before = values.select((F.col("place") + 1).alias("place"), F.col(number).alias("before"))
    return values.join(before, "place", "left").select("place", number, (F.coalesce("before", F.lit(0)) + 1).alias(f"low_{number}"))


def threshold_steps(metrics: DataFrame) -> DataFrame:
    """The threshold grid where it changes: from low_e to e least episodes, and low_c to c least companies, there are investor_count investors.

    Investors are counted by their two numbers first, and only numbers that occur are steps:
    of K events there can be no more than about the root of 2 K different ones.
    """
    cells = metrics.groupBy(F.col("n_core_episode_count").alias("e"), F.col("n_all_interface_companies").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells.filter("e >= 1 and c >= 1"))
    e, c = written(_steps(cells, "e")), written(_steps(cells, "c"))
    # Per step of episodes the steps of companies that anyone reaches who has as many episodes or more.
    most = cells.groupBy("e").agg(F.max("c").alias("c")).join(c.select("c", "place"), "c").select("e", "place")
    most = most.withColumn("most", F.max("place").over(Window.orderBy(F.col("e").desc())))
    grid = most.select("e", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("place")).join(c.select("place", "c"), "place").drop("place")
    counted = grid.join(cells, ["e", "c"], "left").na.fill(0, ["n"])
    counted = _at_least(_at_least(counted, "c", "e"), "e", "c")
    return counted.join(e.drop("place"), "e").join(c.drop("place"), "c").select("low_e", "e", "low_c", "c", F.col("n").alias("investor_count"))


def threshold_grid(metrics: DataFrame) -> DataFrame:
    """For every least number of episodes and of companies that anyone reaches, how many investors reach both: threshold_steps() written out."""
    rows = threshold_steps(metrics).withColumn("minimum_core_episode_count", F.explode(F.sequence("low_e", "e"))).withColumn("minimum_all_interface_companies", F.explode(F.sequence("low_c", "c")))
    return rows.select("minimum_core_episode_count", "minimum_all_interface_companies", "investor_count")


def duplicate_sensitive(metrics: DataFrame) -> DataFrame:
    """Investors that pass the legacy gate by rows but not by episodes."""
    return metrics.filter(F.col("passes_legacy_raw_gate_5_3") & ~F.col("passes_legacy_episode_gate_5_3")).select("investor_id")


def behavior_combinations(events: DataFrame) -> DataFrame:
    """How many investor-company pairs show which combination of core types."""
    shown = F.array_sort(F.array_compact(F.array(*[F.when(F.bool_or(F.col("event_type") == t), F.lit(t)) for t in CORE])))
    pairs = events.groupBy("investor_id", "company_id").agg(F.array_join(shown, "+").alias("combination"))
    return pairs.groupBy("combination").agg(F.count(F.lit(1)).alias("n_pairs"))


#: Core types that count as governance or ownership, and the seven rankings of candidates.
GOVERNANCE = ("board_change", "major_holder_change", "secondary_transaction", "activist_action")
RANKINGS = {
    "breadth": "n_all_interface_companies",
    "core_activity": "n_core_episode_count",
    "acquisition_exit": "n_exit_episode_count",
    "strategic_investment": "n_strategic_investment_episode_count",
    "governance_and_ownership": "n_governance_and_ownership_episode_count",
    "follow_on_funding": "n_funding_participation_rows",
    "funding_to_exit": "n_funding_to_exit_companies",
}


def comparison_table(metrics: DataFrame) -> DataFrame:
    """Investors that pass the primary gate, with their governance episodes and behavior signature (exit, strategic investment, governance or ownership)."""
    governance = sum((F.col(f"n_{t}_episode_count") for t in GOVERNANCE), F.lit(0)).cast("long")
    rows = metrics.filter("passes_primary_episode_gate_3_3").withColumn("n_governance_and_ownership_episode_count", governance)
    parts = {"exit": "n_exit_episode_count", "strategic_investment": "n_strategic_investment_episode_count", "governance_or_ownership": "n_governance_and_ownership_episode_count"}
    return rows.withColumn("core_behavior_signature", F.concat_ws("+", *[F.when(F.col(c) > 0, F.lit(k)) for k, c in parts.items()]))


def signature_groups(table: DataFrame) -> DataFrame:
    """Per behavior signature of comparison_table(): candidates, sums, and whether the signature repeats."""
    sums = {"core_episode_count": "n_core_episode_count", "exit_episode_count": "n_exit_episode_count", "strategic_investment_episode_count": "n_strategic_investment_episode_count", "governance_and_ownership_episode_count": "n_governance_and_ownership_episode_count", "funding_participation_rows": "n_funding_participation_rows"}
    once = F.count(F.lit(1))
    return table.groupBy("core_behavior_signature").agg(once.alias("candidate_count"), *[F.sum(c).alias(f"aggregate_{k}") for k, c in sums.items()], (once >= 2).alias("repeated"))


def rankings(table: DataFrame) -> DataFrame:
    """Candidates in each of RANKINGS: ranking, candidate_rank (the larger number, then the name's bytes), investor, value, and whether it leads.

    The rank is one over the whole table, made for all rankings together: a row for each
    ranking and candidate, placed by the ranges of ranking and value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ranking"), F.col(c).cast("long").alias("value")) for k, c in RANKINGS.items()]))
    rows = table.select("investor_id", "investor_name", each.alias("r")).select("r.ranking", "r.value", "investor_id", "investor_name")
    placed = written(global_rank(rows, "place", F.col("ranking"), -F.col("value"), F.col("investor_name"), F.col("investor_id")))
    first = placed.groupBy("ranking").agg(F.min("place").alias("first"), F.max("value").alias("top"))
    return placed.join(F.broadcast(first), "ranking").select("ranking", (F.col("place") - F.col("first") + 1).alias("candidate_rank"), "investor_id", "investor_name", "value", (F.col("value") == F.col("top")).alias("leads"))


def distributions(confirmed: DataFrame) -> DataFrame:
    """Events and companies per investor of confirmed rows: measure, minimum, median, mean, maximum, investors. confirmed: investor_id, company_id.

    Investors are counted by their number first, so the median is found among numbers that occur.
    """
    per = confirmed.groupBy("investor_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("company_id").alias("companies"))
    each = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in ("events", "companies")])).alias("m")).select("m.*")
    counted = each.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("measure").orderBy("value")
    counted = counted.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("measure"))})
    middle = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    median = (middle(F.ceil(F.col("all") / 2)) + middle(F.floor(F.col("all") / 2) + 1)) / 2
    return counted.groupBy("measure").agg(F.min("value").alias("minimum"), median.alias("median"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.max("value").alias("maximum"), F.sum("n").alias("investors"))


def type_summary(confirmed: DataFrame, types: DataFrame) -> DataFrame:
    """Per investor type (an investor may have several): investors, event rows and their share of all rows. types: investor_id, investor_types (array)."""
    total = confirmed.agg(F.count(F.lit(1)).alias("all"))
    typed = types.select("investor_id", F.explode(F.array_distinct("investor_types")).alias("investor_type"))
    rows = confirmed.groupBy("investor_id").agg(F.count(F.lit(1)).alias("n")).join(typed, "investor_id")
    per = rows.groupBy("investor_type").agg(F.count(F.lit(1)).alias("investors"), F.sum("n").alias("event_rows"))
    return per.crossJoin(F.broadcast(total)).select("investor_type", "investors", "event_rows", (F.col("event_rows") / F.col("all")).alias("event_row_share"))  # a single row


def compare_candidates(metrics: DataFrame) -> DataFrame:
    """Investors that pass the primary gate, grouped by their signature of core types: size, sums and the leader."""
    shown = F.array_compact(F.array(*[F.when(F.col(f"n_{t}_episode_count") > 0, F.lit(t)) for t in CORE]))
    rows = metrics.filter("passes_primary_episode_gate_3_3").withColumn("signature", F.array_join(shown, "+"))
    return rows.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_investors"),
        F.sum("n_core_episode_count").alias("n_core_episodes"),
        F.sum("n_all_interface_companies").alias("n_companies"),
        F.min_by("investor_id", F.struct((-F.col("n_core_episode_count")).alias("a"), (-F.col("n_all_interface_companies")).alias("b"), "investor_name", "investor_id")).alias("leader"),
    )
