"""The row that rules look at: chain, derived fields and events, one row per chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import names
from eventloom.operators import chains as ops
from eventloom.plans.rules import timing

YEAR = 365.25


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def participant(investor_id: Column, raw_name: Column) -> tuple[Column, Column]:
    """(key, basis) of an event's participant: its identifier, else its name."""
    ident, name = F.nullif(F.trim(investor_id), F.lit("")), names.identity(raw_name, compatible=True)
    key = F.coalesce(F.concat(F.lit("id:"), ident), F.concat(F.lit("raw:"), name))
    return key, F.when(ident.isNotNull(), "resolved_id").when(name.isNotNull(), "raw_name").otherwise("none")


def events_of(members: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain_id, events): the chain's events as structs with their intervals, batches and distances.

    members: chain_id, event_id, family, event_type, event_subtype, event_date, investor_id, raw_investor_name.
    chains: chain_id, chain_start_date, chain_end_date, chain_window_status.
    """
    rows = ops.with_interval(members).join(chains.select("chain_id", "chain_start_date", "chain_end_date", "chain_window_status"), "chain_id")
    dated = F.col("chain_window_status") == "dated"
    in_order = ["lo", "hi", "family", "event_type", "event_id"]
    usable = rows.withColumn("_lo", F.when(dated, F.col("lo")))

    def numbered(df: DataFrame, name: str, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys, F.col("_lo").isNull()).orderBy(*in_order)
        reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("_lo").isNotNull() & (reach.isNull() | (F.col("lo") > reach)), 1).otherwise(0)
        return df.withColumn("_new", new).withColumn(name, F.when(F.col("_lo").isNotNull(), F.sum("_new").over(w))).drop("_new")

    rows = numbered(numbered(usable, "batch", "chain_id"), "family_batch", "chain_id", "family")
    exact = lambda c: F.when(F.length(c) == 10, F.try_to_date(c, "yyyy-MM-dd"))
    start, end = exact(F.col("chain_start_date")), F.when(dated, exact(F.col("chain_end_date")))
    # Ahead of the aggregate: names that aren't ASCII pass through Python.
    key, basis = participant(F.col("investor_id"), F.col("raw_investor_name"))
    rows = rows.withColumns({"participant_key": key, "participant_basis": basis})
    event = F.struct(
        *in_order, "batch", "family_batch", "event_subtype", "event_date", "investor_id", "raw_investor_name",
        F.col("precision").alias("date_precision"), F.col("lo").alias("date_min"), F.col("hi").alias("date_max"),
        "participant_key", "participant_basis",
        F.datediff(end, F.col("hi")).alias("days_before_chain_end_min"), F.datediff(end, F.col("lo")).alias("days_before_chain_end_max"),
        F.datediff(F.col("lo"), start).alias("days_after_chain_start_min"), F.datediff(F.col("hi"), start).alias("days_after_chain_start_max"),
    )
    return rows.groupBy("chain_id").agg(F.array_sort(F.collect_list(event)).alias("events"))


def build(chains: DataFrame, members: DataFrame, with_history: bool = True) -> DataFrame:
    """One row per chain: chain (struct), derived (struct), events.

    chains: the columns of the contract; members as events_of() takes them. Without
    history every chain counts as its company's only one.
    """
    events = events_of(members, chains)
    schema = events.schema["events"].dataType
    rows = chains.join(events, "chain_id", "left").withColumn("events", F.coalesce("events", F.array().cast(schema)))
    raw = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x: names.identity(x)), lambda x: x.isNotNull()))
    ids = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    rows = rows.withColumns({"_raw": raw(F.col("investor_raw_names")), "_ids": ids(F.col("investor_ids"))})
    rows = rows.withColumn("investor_keys", F.concat(F.transform("_ids", lambda x: F.concat(F.lit("id:"), x)), F.transform("_raw", lambda x: F.concat(F.lit("raw:"), x))))
    rows = rows.withColumn("end", F.when(F.col("chain_window_status") == "dated", F.try_to_date("chain_end_date", "yyyy-MM-dd")))
    if with_history:
        rows = ops.history(rows.withColumnRenamed("outcome_round", "round_name")).withColumnRenamed("round_name", "outcome_round")
    else:
        rows = rows.withColumns(
            {
                "outcome_round_bucket": names.round_bucket(F.col("outcome_round")), "n_prior_chains": F.lit(0), "company_chain_count": F.lit(1), "is_last_chain": F.lit(True),
                "chain_position_bucket": F.lit("first"), "prior_same_round_count": F.lit(0), "round_occurrence_index": F.lit(1),
                "days_since_previous_same_round": F.lit(None).cast("int"), "prior_outcome_investor_overlap_count": F.lit(0),
                "prior_outcome_investor_overlap_ratio": F.lit(None).cast("double"), "has_prior_outcome_investor_overlap": F.lit(False),
            }
        )

    start = F.when(F.col("chain_start_date") != "founding", F.try_to_date("chain_start_date", "yyyy-MM-dd"))
    duration = F.datediff(F.col("end"), start)
    interface = F.filter("events", lambda e: e["family"] == "interface")
    keys = F.array_distinct(F.filter(F.transform(interface, lambda e: e["participant_key"]), lambda k: k.isNotNull()))
    bases = F.array_distinct(F.filter(F.transform(interface, lambda e: e["participant_basis"]), lambda b: b != "none"))
    basis = (
        F.when(F.size(bases) == 0, "none").when(F.size(bases) == 2, "mixed_resolved_id_raw_fallback")
        .when(F.array_contains(bases, "resolved_id"), "resolved_ids").otherwise("normalized_raw_names_fallback")
    )
    middle = F.col("n_exposure") + F.col("n_interface")
    rows = rows.withColumn("_spans", _batch_spans(F.col("events")))
    n_batches = F.size("_spans")
    gap = lambda left, right: F.when(n_batches >= 2, F.transform(F.sequence(F.lit(1), n_batches - 1), lambda k: F.datediff(F.col("_spans")[k][right], F.col("_spans")[k - 1][left])))
    first, last = F.col("_spans")[0], F.element_at("_spans", -1)
    several = n_batches >= 2
    derived = {
        "n_middle": middle,
        "n_raw_outcome_investors": F.size("investor_raw_names"),
        "n_resolved_outcome_investors": F.size("investor_ids"),
        "outcome_investor_count": F.when(F.size("_raw") > 0, F.size("_raw")).otherwise(F.size("_ids")),
        "outcome_investor_basis": F.when(F.size("_raw") > 0, "unique_raw_names").otherwise("resolved_ids_fallback"),
        "chain_duration_days": duration,
        "outcome_round_known": ~F.col("outcome_round_bucket").isin("unknown", "other"),
        "n_ordered_batches": n_batches,
        "n_comparable_gaps": F.greatest(n_batches - 1, F.lit(0)),
        "n_known_date_middle_events": F.size(F.filter("events", lambda e: e["lo"].isNotNull())),
        "middle_span_min": F.when(several, F.datediff(last["lo"], first["hi"])),
        "middle_span_max": F.when(several, F.datediff(last["hi"], first["lo"])),
        "min_interbatch_gap_min": F.array_min(gap("hi", "lo")),
        "min_interbatch_gap_max": F.array_min(gap("lo", "hi")),
        "max_interbatch_gap_min": F.array_max(gap("hi", "lo")),
        "max_interbatch_gap_max": F.array_max(gap("lo", "hi")),
        "n_unique_interface_investors_resolved": F.size(ids(F.transform(interface, lambda e: e["investor_id"]))),
        "n_unique_interface_raw_names": F.size(raw(F.transform(interface, lambda e: e["raw_investor_name"]))),
        "interface_investor_count": F.size(keys),
        "interface_investor_basis": basis,
        "exposure_share": _share(F.col("n_exposure"), middle),
        "interface_share": _share(F.col("n_interface"), middle),
        "events_per_chain_year": F.when(duration > 0, middle * YEAR / duration),
        "batches_per_chain_year": F.when(duration > 0, n_batches * YEAR / duration),
    }
    of_family = lambda family: F.filter("events", lambda e: e["family"] == family)
    for family in ("any", "exposure", "interface"):
        mine = F.col("events") if family == "any" else of_family(family)
        for bound in ("min", "max"):
            derived[f"first_{family}_after_start_{bound}"] = timing(mine, "days_after_chain_start", "first", bound)
            derived[f"last_{family}_before_end_{bound}"] = timing(mine, "days_before_chain_end", "last", bound)
    held = ("outcome_round_bucket", "n_prior_chains", "company_chain_count", "is_last_chain", "chain_position_bucket", "prior_same_round_count", "round_occurrence_index", "days_since_previous_same_round", "prior_outcome_investor_overlap_count", "prior_outcome_investor_overlap_ratio", "has_prior_outcome_investor_overlap")
    rows = rows.withColumns({f"_{k}": v for k, v in derived.items()})
    return rows.select(F.struct(*chains.columns).alias("chain"), F.struct(*[F.col(f"_{k}").alias(k) for k in derived], *held).alias("derived"), "events")


def _batch_spans(events: Column) -> Column:
    """array of (lo, hi), one for each batch in order."""
    numbers = F.array_distinct(F.filter(F.transform(events, lambda e: e["batch"]), lambda b: b.isNotNull()))

    def span(b: Column) -> Column:
        mine = F.filter(events, lambda e: e["batch"] == b)
        return F.struct(F.array_min(F.transform(mine, lambda e: e["lo"])).alias("lo"), F.array_max(F.transform(mine, lambda e: e["hi"])).alias("hi"))

    return F.transform(F.array_sort(numbers), span)


def order_status(window_status: Column, events: Column) -> Column:
    """How well the order of the middle events is known."""
    exact = F.forall(events, lambda e: e["date_precision"].eqNullSafe("day"))
    return F.when(window_status == "unknown_end_date", "unknown_end").when(F.size(events) == 0, "no_middle").when(exact, "exact").otherwise("partial_batches")


def straddling(events: Column, start: Column, end: Column) -> Column:
    """Identifiers of events that aren't dated to a day and whose interval crosses the start or the end."""
    loose = F.filter(events, lambda e: (e["date_precision"] != "day") & (((e["lo"] < start) & (e["hi"] >= start)) | ((e["lo"] < end) & (e["hi"] >= end))))
    return F.transform(loose, lambda e: e["event_id"])


