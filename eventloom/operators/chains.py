"""Claims, events and chains.

An outcome closes a chain; the chain collects the company's other events since its last
dated outcome. Membership is an as-of problem: an event belongs to the first outcome after
it, so one window per company, over outcomes and events together, assigns them all. No
range join is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import names
from eventloom.functions.dates import boundary_date, partial_date, valid_partial_date

#: Outcomes whose participants are a lead and co-investors, and those with an acquirer.
LED = ("funding_round", "funding_failed", "funding_withdrawn")
ACQUIRED = ("acquired",)


def participants(claims: DataFrame) -> DataFrame:
    """One row per participant: the lead and the co-investors of a round, the acquirer of an acquisition.

    A round without any, and any other outcome, has one row of role unknown; an acquirer
    that isn't named is a row without a name. claims: event_type, lead_investor,
    co_investors (array), acquirer and any other columns.
    """
    person = lambda name, role: F.struct(name.alias("name"), F.lit(role).alias("role"))
    lead = F.array(person(F.col("lead_investor"), "lead"))
    co = F.transform(F.coalesce("co_investors", F.array().cast("array<string>")), lambda x: person(x, "co"))
    named = F.filter(F.concat(lead, co), lambda p: p["name"].isNotNull() & (p["name"] != ""))
    nobody = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("unknown").alias("role")))
    everyone = F.when(F.col("event_type").isin(*ACQUIRED), F.array(person(F.col("acquirer"), "acquirer"))).when(F.col("event_type").isin(*LED) & (F.size(named) > 0), named).otherwise(nobody)
    return claims.withColumn("participant", F.explode(everyone)).select(
        *[c for c in claims.columns if c not in ("lead_investor", "co_investors", "acquirer")],
        F.col("participant.name").alias("investor_name"),
        F.col("participant.role").alias("role"),
    )


def match_investors(events: DataFrame, investors: DataFrame, name_col: str = "investor_name") -> DataFrame:
    """Adds investor_id by the name's slug, else by its normalized name, both against the investors' slugs.

    investors: investor_id, slug, row (the later row of a slug wins). A name that is null or
    empty has none.
    """
    by_slug = investors.groupBy("slug").agg(F.max_by("investor_id", "row").alias("investor_id"))
    one = by_slug.select(F.col("slug").alias("_s1"), F.col("investor_id").alias("_i1"))
    two = by_slug.select(F.col("slug").alias("_s2"), F.col("investor_id").alias("_i2"))
    keyed = events.withColumns({"_slug": names.any_slug(F.col(name_col)), "_name": names.normalize_name(F.col(name_col))})
    joined = keyed.join(one, F.col("_slug") == F.col("_s1"), "left").join(two, F.col("_name") == F.col("_s2"), "left")
    return joined.withColumn("investor_id", F.coalesce("_i1", "_i2")).drop("_slug", "_name", "_s1", "_s2", "_i1", "_i2")


def match_by_name(events: DataFrame, investors: DataFrame, name_col: str = "raw_investor_name") -> DataFrame:
    """Adds investor_id by the normalized name alone, against the investors' slugs. investors: investor_id, slug, row (the later row of a slug wins)."""
    by_slug = investors.groupBy(F.col("slug").alias("_s")).agg(F.max_by("investor_id", "row").alias("investor_id"))
    return events.join(by_slug, F.nullif(names.normalize_name(F.col(name_col)), F.lit("")) == F.col("_s"), "left").drop("_s")


def event_rows(claims: DataFrame, types: tuple[str, ...], strict: bool, default_type: str | None = None, date_col: str = "event_date") -> DataFrame:
    """Claims of caches as rows of an event table: type, normalized date, amount and confidence.

    A missing type is ``default_type``. A type outside ``types`` stops the job if ``strict``
    (funding events), else it is ``other`` (exposure and interface events). Dates that are
    none are null, amounts that are no whole number too, a missing confidence is 0.
    Rounds keep the name of their round (``unknown`` without one), other events have none.
    claims: event_type, a date, amount_usd, confidence, round_name, as text.
    """
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit(default_type or "other"))
    known = kind.isin(*types)
    other = F.raise_error(F.concat(F.lit("unknown event type: "), kind)).cast("string") if strict else F.lit("other")
    found = claims.withColumn("event_type", F.when(known, kind).otherwise(other))
    fresh = {date_col: valid_partial_date(F.col(date_col)), "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))}
    if "amount_usd" in claims.columns:
        fresh["amount_usd"] = F.col("amount_usd").try_cast("long")
    if "round_name" in claims.columns:
        fresh["round_name"] = F.when(F.col("event_type").isin(*LED), F.coalesce(F.nullif(names.squeeze(F.col("round_name")), F.lit("")), F.lit("unknown")))
    return found.withColumns(fresh)


def resolve_claims(claims: DataFrame, order: str, fields: list[str], id_col: str = "event_id") -> DataFrame:
    """One row per event: the claim of the highest confidence (the earliest of those), how many there are,
    whether the highest is tied, and the fields in which claims disagree. Null confidence counts 0.
    """
    confidence = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    picked = F.min_by(F.struct(*[c for c in claims.columns if c != id_col]), F.struct((-F.col("_confidence")).alias("c"), F.col(order).alias("o")))
    # The window and the aggregate share one exchange; a field differs if its least and greatest value do.
    per = claims.withColumn("_confidence", confidence)
    per = per.withColumn("_top", F.max("_confidence").over(Window.partitionBy(id_col)))
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\0"))
    differ = [F.when(F.min(text(f)) != F.max(text(f)), F.lit(f)) for f in fields]
    tied = F.count_if(F.col("_confidence") == F.col("_top")) > 1
    found = per.groupBy(id_col).agg(picked.alias("claim"), F.count(F.lit(1)).alias("n_claims"), tied.alias("confidence_tied"), F.array_compact(F.array(*differ)).alias("conflict_fields"))
    return found.select(id_col, "claim.*", "n_claims", "confidence_tied", "conflict_fields")


def claim_lineage(claims: DataFrame, order: str, id_col: str = "event_id") -> DataFrame:
    """All claims of events that have several: claim_ordinal (from 1, in their order), n_claims, and which one was selected, with the claims' own columns.

    Long form, so that an event with very many claims is never one row.
    """
    in_order = Window.partitionBy(id_col).orderBy(order)
    by_trust = Window.partitionBy(id_col).orderBy(F.col("_confidence").desc(), order)
    rows = claims.withColumn("_confidence", F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)))
    made = rows.withColumns({"claim_ordinal": F.row_number().over(in_order).cast("long"), "n_claims": F.count(F.lit(1)).over(Window.partitionBy(id_col)), "selected": F.row_number().over(by_trust) == 1})
    return made.filter("n_claims > 1").drop("_confidence")


def claim_stats(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: claims in, events out, events with several claims, claims collapsed, tied and conflicting events. resolved: of resolve_claims()."""
    several = F.col("n_claims") > 1
    out = resolved.agg(
        F.count(F.lit(1)).alias("output_rows"), F.count_if(several).alias("collision_groups"), F.coalesce(F.sum(F.col("n_claims") - 1), F.lit(0)).alias("claims_collapsed"),
        F.count_if(several & ~F.col("confidence_tied")).alias("unique_highest_confidence_groups"), F.count_if(several & F.col("confidence_tied")).alias("tied_highest_confidence_groups"),
        F.count_if(several & (F.size("conflict_fields") > 0)).alias("semantic_conflict_groups"),
    )
    return out.crossJoin(F.broadcast(claims.agg(F.count(F.lit(1)).alias("input_rows"))))  # two single rows


def group_outcomes(outcomes: DataFrame) -> DataFrame:
    """Participants' rows to one row per outcome: company, type, round, date (nulls are equal).

    outcomes: event_id, company_id, event_type, round_name, announce_date, investor_id, raw_investor_name, ord.
    """
    ordered = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"]), lambda v: v.isNotNull()))
    return outcomes.groupBy("company_id", "event_type", "round_name", "announce_date").agg(
        F.count(F.lit(1)).alias("n_participant_rows"),
        ordered("event_id").alias("outcome_event_ids"),
        ordered("investor_id").alias("investor_ids"),
        ordered("raw_investor_name").alias("investor_raw_names"),
    )


def sequence_outcomes(outcomes: DataFrame) -> DataFrame:
    """Adds end, chain_sequence (from 1; undated outcomes last), start (the last dated end before, or null), chain_id.

    The outcomes of a company, not its events, are sorted in one task.

    outcomes: company_id, event_type, round_name, announce_date (text).
    """
    with_end = outcomes.withColumn("end", boundary_date(F.col("announce_date")))
    in_order = Window.partitionBy("company_id").orderBy(F.col("end").isNull(), "end", "event_type", F.coalesce("round_name", F.lit("")))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    made = with_end.withColumns({"chain_sequence": F.row_number().over(in_order).cast("long"), "start": F.last("end", ignorenulls=True).over(before)})
    end_text = F.coalesce(F.col("end").cast("string"), F.lit("unknown"))
    return made.withColumn("chain_id", names.hash_id("chain", F.col("company_id"), F.col("event_type"), F.col("round_name"), end_text))


def assign_events(chains: DataFrame, events: DataFrame) -> DataFrame:
    """Adds chain_sequence to the events that fall into a chain; the rest are left out.

    An event on the day of an outcome belongs to the chain after it. Where outcomes share a
    day, only the first of them has a window that isn't empty, and it gets the events.
    chains: company_id, chain_sequence, end; events: company_id, day and any other columns.

    The next outcome is looked for in the event's month, by a window over company and month,
    else it is the first one of a later month; those are found among the months of a company.
    So no task holds all events of a company, however many it has.
    """
    dated = chains.filter(F.col("end").isNotNull()).groupBy("company_id", "end").agg(F.min("chain_sequence").alias("_seq"))
    extra = [c for c in events.columns if c not in ("company_id", "day")]
    ends = dated.select("company_id", F.col("end").alias("day"), "_seq", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in extra])
    both = events.filter(F.col("day").isNotNull()).select("company_id", "day", F.lit(None).cast("long").alias("_seq"), *extra).unionByName(ends).withColumn("_month", F.trunc("day", "month"))
    # Sorted backwards, the outcome seen last is the next one. An event of that very day comes before it.
    later = Window.partitionBy("company_id", "_month").orderBy(F.col("day").desc(), F.col("_seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_next", F.last("_seq", ignorenulls=True).over(later)).filter("_seq IS NULL")
    firsts = both.groupBy("company_id", "_month").agg(F.min("_seq").alias("_first"))
    after = Window.partitionBy("company_id").orderBy(F.col("_month").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_far", F.last("_first", ignorenulls=True).over(after)).drop("_first")
    joined = found.join(firsts, ["company_id", "_month"]).withColumn("chain_sequence", F.coalesce("_next", "_far"))
    return joined.filter(F.col("chain_sequence").isNotNull()).drop("_seq", "_next", "_far", "_month")


def build_chains(outcomes: DataFrame, exposure: DataFrame, interface: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """Chains with the identifiers and types of their events, by family.

    outcomes as sequence_outcomes() takes them; exposure and interface: event_id, company_id, event_type, event_date (text);
    inside: what assign_events() made of the two, where it is there already (company_id, chain_sequence, day, event_id, event_type, family).
    """
    chains = sequence_outcomes(outcomes)
    family = lambda df, name: df.select("company_id", boundary_date(F.col("event_date")).alias("day"), "event_id", "event_type", F.lit(name).alias("family"))
    if inside is None:
        inside = assign_events(chains, family(exposure, "exposure").unionByName(family(interface, "interface")))
    by_chain = inside.groupBy("company_id", "chain_sequence").agg(F.array_sort(F.collect_list(F.struct("day", "event_id", "event_type", "family"))).alias("middle"))
    joined = chains.join(by_chain, ["company_id", "chain_sequence"], "left")
    out = joined.withColumn("middle", F.coalesce("middle", F.array().cast("array<struct<day:date,event_id:string,event_type:string,family:string>>")))
    of_family = lambda name: F.filter("middle", lambda e: e["family"] == name)
    for name in ("exposure", "interface"):
        mine = of_family(name)
        out = out.withColumns({f"n_{name}": F.size(mine).cast("long"), f"{name}_event_ids": F.transform(mine, lambda e: e["event_id"]), f"{name}_types": F.array_distinct(F.transform(mine, lambda e: e["event_type"]))})
    return out.withColumns(
        {
            "chain_start_date": F.coalesce(F.col("start").cast("string"), F.lit("founding")),
            "chain_end_date": F.coalesce(F.col("end").cast("string"), F.lit("unknown")),
            "chain_window_status": F.when(F.col("end").isNull(), "unknown_end_date").otherwise("dated"),
        }
    )


def batches(events: DataFrame, *keys: str) -> DataFrame:
    """Adds batch (from 1): events of a key whose date intervals overlap, directly or through others, share one.

    events: keys, lo, hi and the tie-breaking columns family, event_type, event_id.
    """
    in_order = Window.partitionBy(*keys).orderBy("lo", "hi", "family", "event_type", "event_id")
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    return events.withColumn("_new", fresh).withColumn("batch", F.sum("_new").over(in_order).cast("long")).drop("_new")


def batch_gaps(batched: DataFrame, *keys: str) -> DataFrame:
    """Per key: n_ordered_batches, spans and the least and largest gaps between neighbouring batches, in days."""
    per = batched.groupBy(*keys, "batch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    in_order = Window.partitionBy(*keys).orderBy("batch")
    gaps = per.withColumns({"g_min": F.datediff("lo", F.lag("hi").over(in_order)), "g_max": F.datediff("hi", F.lag("lo").over(in_order))})
    out = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_ordered_batches"),
        F.min("g_min").alias("min_interbatch_gap_min"),
        F.min("g_max").alias("min_interbatch_gap_max"),
        F.max("g_min").alias("max_interbatch_gap_min"),
        F.max("g_max").alias("max_interbatch_gap_max"),
        F.datediff(F.max_by("lo", "batch"), F.min_by("hi", "batch")).alias("s_min"),
        F.datediff(F.max_by("hi", "batch"), F.min_by("lo", "batch")).alias("s_max"),
    )
    several = F.col("n_ordered_batches") >= 2
    return out.select(*keys, "n_ordered_batches", (F.col("n_ordered_batches") - 1).alias("n_comparable_gaps"), F.when(several, F.col("s_min")).alias("middle_span_min"), F.when(several, F.col("s_max")).alias("middle_span_max"), *[f"{a}_interbatch_gap_{b}" for a in ("min", "max") for b in ("min", "max")])


def history(chains: DataFrame) -> DataFrame:
    """Adds what came before in the company: counts, positions, the last chain of the same round, shared investors.

    chains: company_id, chain_sequence, chain_id, round_name, end, investor_keys (array).
    """
    bucket = names.round_bucket(F.col("round_name"))
    rows = chains.withColumn("outcome_round_bucket", bucket)
    company = Window.partitionBy("company_id").orderBy("chain_sequence", "chain_id")
    whole = Window.partitionBy("company_id")
    same = Window.partitionBy("company_id", "outcome_round_bucket").orderBy("chain_sequence", "chain_id")
    known = F.col("outcome_round_bucket") != "unknown"
    prior_same = F.when(known, F.row_number().over(same) - 1).otherwise(0)
    last_same = F.when(known, F.last("end", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1)))
    ordinal, count = F.row_number().over(company), F.count(F.lit(1)).over(whole)
    # An investor is shared where one of its earlier chains in the company is known: its first one decides.
    # All of this stays within the company's partition. Only a chain's first investor row carries the chain's columns,
    # and the row that is kept, so what is sorted for the others is a key; the array of keys is in no sort but its own caller's.
    at = F.struct("chain_sequence", "chain_id")
    own = F.array_distinct("investor_keys")
    rows = rows.withColumn("_own", F.when(F.col("investor_keys").isNotNull(), F.size(own)))
    met = rows.select(*rows.columns, F.posexplode_outer(own).alias("_pos", "_key"))
    first = F.coalesce("_pos", F.lit(0)) == 0
    met = met.select("company_id", "chain_sequence", "chain_id", "_pos", "_key", *[F.when(first, F.col(c)).alias(c) for c in rows.columns if c not in ("company_id", "chain_sequence", "chain_id")])
    met = met.withColumn("_met", F.min(F.when(F.col("_pos").isNotNull(), at)).over(Window.partitionBy("company_id", "_key")) < at).drop("_key")
    met = met.withColumn("_shared", F.count_if("_met").over(Window.partitionBy("company_id", "chain_sequence", "chain_id")).cast("int"))
    rows = met.filter(first).select(*rows.columns, "_shared")
    current = F.col("_own")
    shared = F.when(current.isNotNull(), F.when(current > 0, F.col("_shared")).otherwise(0))
    return rows.withColumns(
        {
            "n_prior_chains": (ordinal - 1).cast("long"),
            "company_chain_count": count,
            "is_last_chain": ordinal == count,
            "chain_position_bucket": F.when(ordinal == 1, "first").when(ordinal == count, "last").when(ordinal <= 3, "early").otherwise("later"),
            "prior_same_round_count": prior_same.cast("long"),
            "round_occurrence_index": (prior_same + 1).cast("long"),
            "days_since_previous_same_round": F.datediff("end", last_same),
            "prior_outcome_investor_overlap_count": shared.cast("long"),
            "prior_outcome_investor_overlap_ratio": F.when(current > 0, shared / current),
            "has_prior_outcome_investor_overlap": shared > 0,
        }
    ).drop("_shared", "_own")


def with_interval(events: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Adds lo, hi and precision of a partial date."""
    return events.withColumn("_d", partial_date(F.col(date_col))).withColumns({"lo": F.col("_d.lo"), "hi": F.col("_d.hi"), "precision": F.col("_d.precision")}).drop("_d")


def batch_tokens(batched: DataFrame, *keys: str) -> DataFrame:
    """One row per batch: its events as ``{E:type|I:type}``, in the order of family, type and identifier. batched: keys, batch, family, event_type, event_id."""
    token = F.transform(F.array_sort(F.collect_list(F.struct("family", "event_type", "event_id"))), lambda e: F.concat(F.upper(F.substring(e["family"], 1, 1)), F.lit(":"), e["event_type"]))
    return batched.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("{"), F.array_join(token, "|"), F.lit("}")).alias("token"))


def signatures(batched: DataFrame, *keys: str) -> DataFrame:
    """Per key: n_middle, and the signature: the tokens of its batches joined by ``>``. Each event is read once."""
    token = F.transform(F.array_sort(F.collect_list(F.struct("batch", "token"))), lambda t: t["token"])
    return batch_tokens(batched, *keys).groupBy(*keys).agg(F.sum("n").cast("int").alias("n_middle"), F.array_join(token, ">").alias("signature"))


def signature(events: Column) -> Column:
    """The same for an array of structs (batch, family, event_type, event_id) in that order: a token is closed where the batch changes."""
    token = lambda e: F.concat(F.upper(F.substring(e["family"], 1, 1)), F.lit(":"), e["event_type"])
    none = F.struct(F.lit("").alias("text"), events[0]["batch"].alias("batch"))
    add = lambda s, e: F.struct(F.concat(s["text"], F.when(s["text"] == "", "{").when(s["batch"] == e["batch"], "|").otherwise("}>{"), token(e)).alias("text"), e["batch"].alias("batch"))
    return F.when(F.size(events) > 0, F.concat(F.aggregate(events, none, add)["text"], F.lit("}"))).otherwise("")
