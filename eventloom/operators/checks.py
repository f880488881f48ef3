"""Contract checks, as DataFrames of violations or arrays of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unknown_keys(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def single_version(df: DataFrame, column: str = "schema_version") -> DataFrame:
    """One row: how many versions there are, and whether it is a single one."""
    return df.agg(F.count_distinct(column).alias("n_versions"), (F.count_distinct(column) == 1).alias("single"))


def chain_violations(chains: DataFrame, events: DataFrame, companies: DataFrame) -> DataFrame:
    """(subject, violation) of chains, events and companies against the chains' contract; a subject is the identifier of what breaks it.

    events: event_id, family, company_id, event_type (exposure and interface); companies: company_id, label.
    """
    violation = lambda df, key, name: df.select(F.col(key).cast("string").alias("subject"), F.lit(name).alias("violation"))
    found = violation(duplicate_keys(companies, "company_id"), "company_id", "repeated company")
    found = found.unionByName(violation(duplicate_keys(chains, "chain_id"), "chain_id", "repeated chain"))
    found = found.unionByName(violation(unknown_keys(events, "company_id", companies, "company_id"), "event_id", "event of an unknown company"))

    labels = companies.groupBy("company_id").agg(F.min("label").alias("_label"), F.lit(True).alias("_known"))
    known = chains.join(labels, "company_id", "left")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd").isNotNull()
    status, families = F.col("chain_window_status"), ("exposure", "interface")
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    rules = {
        "unknown company": F.col("_known").isNull(),
        "label differs": F.col("_known") & ~F.col("_label").eqNullSafe(F.col("company_label_v4")),
        "unknown window status": ~F.coalesce(status.isin("dated", "unknown_end_date"), F.lit(False)),
        "end isn't a day": (status == "dated") & ~day("chain_end_date"),
        "undated chain with an end": (status == "unknown_end_date") & ~F.col("chain_end_date").eqNullSafe(F.lit("unknown")),
        "start isn't a day": ~F.col("chain_start_date").eqNullSafe(F.lit("founding")) & ~day("chain_start_date"),
        "participants differ": F.col("n_participant_rows") != size("outcome_event_ids"),
        "counts differ": reduce(lambda a, b: a | b, [(F.col(f"n_{f}") != size(f"{f}_event_ids")) | (size(f"{f}_event_ids") != size(f"{f}_types")) for f in families]),
        "repeated event": reduce(lambda a, b: a | b, [F.size(f"{f}_event_ids") != F.size(F.array_distinct(f"{f}_event_ids")) for f in families]),
        "undated chain with events": (status == "unknown_end_date") & (F.col("n_exposure") + F.col("n_interface") > 0),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    found = found.unionByName(known.select(F.col("chain_id").cast("string").alias("subject"), broken.alias("violation")))

    def listed(family: str) -> Column:
        pairs = F.arrays_zip(F.col(f"{family}_event_ids").alias("id"), F.col(f"{family}_types").alias("type"))
        return F.transform(pairs, lambda x: F.struct(x["id"].alias("event_id"), x["type"].alias("type"), F.lit(family).alias("family")))

    zipped = [listed(f) for f in families]
    refs = chains.select("chain_id", "company_id", F.explode(F.concat(*zipped)).alias("ref")).select("chain_id", "company_id", "ref.*")
    e = events.select("event_id", F.col("family").alias("_f"), F.col("company_id").alias("_c"), F.col("event_type").alias("_t"))
    joined = refs.join(e, "event_id", "left")
    wrong = F.when(F.col("_f").isNull(), "missing event").when(F.col("_f") != F.col("family"), "event of another family").when(F.col("_c") != F.col("company_id"), "event of another company").when(~F.col("_t").eqNullSafe(F.col("type")), "event of another type")
    return found.unionByName(joined.select(F.col("chain_id").cast("string").alias("subject"), wrong.alias("violation")).filter("violation IS NOT NULL").distinct())


#: Headings and fields that a candidate card must have, the least words of a section, and the years allowed.
CARD_SECTIONS = ("Revenue model", "Customer segmentation", "Cost structure", "Differentiation", "Strategic vulnerabilities")
CARD_FIELDS = ("Slug", "Public/private", "Founding year", "Original proposal description", "Closest existing vendor analogues")
SECTION_WORDS, FIRST_YEAR, LAST_YEAR = 50, 1900, 2099


def card_messages(card: Column) -> Column:
    """What is wrong with a card, as an array of messages that begin with FAIL or WARN."""
    section = lambda s: F.regexp_extract(card, rf"(?ims)(^\s*#{{1,3}}\s+(?:\d+\.\s+)?{s}.*?)(?=^#{{1,3}}\s+(?:\d+\.\s+)?\w|\z)", 1)
    year = F.regexp_extract(card, r"(?i)Founding\s*year\*{0,2}\s*[:：]\s*[`'\"]?(\d{4})[`'\"]?", 1)
    archetype = card.rlike(r"(?im)^\s*\*{0,2}Archetype\*{0,2}\s*[:：]")
    facts = F.struct(archetype.alias("archetype"), F.lower(card).alias("lower"), year.alias("year"), F.array(*map(section, CARD_SECTIONS)).alias("sections"))
    # A lambda's variable holds what is read from the card, so that each expression goes over it once.
    return F.transform(F.array(facts), _card_messages)[0]


def _card_messages(facts: Column) -> Column:
    year, section = facts["year"], {s: facts["sections"][k] for k, s in enumerate(CARD_SECTIONS)}
    has = lambda f: facts["lower"].contains(f.lower())
    found = [F.when(facts["archetype"], F.lit("FAIL: an archetype is not allowed"))]
    # A section begins with its heading: without one, it is empty.
    found += [F.when(section[s] == "", F.lit(f"FAIL: section {s} is missing")) for s in CARD_SECTIONS]
    found += [F.when(~has(f), F.lit(f"FAIL: field {f} is missing")) for f in CARD_FIELDS]
    found.append(F.when(has("Founding year") & (year == ""), F.lit("FAIL: the founding year is no year")))
    found.append(F.when((year != "") & ~year.cast("int").between(FIRST_YEAR, LAST_YEAR), F.lit("FAIL: the founding year is out of range")))
    for s in CARD_SECTIONS:
        words = F.size(F.regexp_extract_all(section[s], F.lit(r"\w+"), 0))
        found.append(F.when((section[s] != "") & (words < SECTION_WORDS), F.lit(f"WARN: section {s} is short")))
    risks = section["Strategic vulnerabilities"]
    found.append(F.when((risks != "") & ~risks.rlike(r"(?m)^\s*(?:[-*]|\d+\.)\s+\S"), F.lit("FAIL: no risk is listed")))
    return F.array_compact(F.array(*found))


def score_messages(m: Column, u: Column, verdict: Column, score: Column) -> Column:
    """What is wrong with a proposal's aggregate: verdicts outside the scale, a score or verdict that doesn't follow."""
    from eventloom.functions.stats import aggregate_score, aggregate_verdict

    scale = ("PASS", "WARN", "FAIL")
    expected = aggregate_score(m, u)
    tests = [(~F.coalesce(v.isin(*scale), F.lit(False)), f"FAIL: {k} is no verdict") for k, v in (("M", m), ("U", u), ("the verdict", verdict))]
    known = m.isin(*scale) & u.isin(*scale)
    tests += [(known & (F.abs(score - expected) > 0.005), "FAIL: the score doesn't follow from M and U"), (known & (verdict != aggregate_verdict(expected)), "FAIL: the verdict doesn't follow from the score")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in tests]))


def mark_sum_messages(marks: list[Column], stated: Column, tolerance: float = 0.05) -> Column:
    """Whether marks (✓, partial, ✗) add up to the stated sum: 1, 0.5 and 0."""
    value = lambda c: F.when(c == "✓", 1.0).when(c == "partial", 0.5).otherwise(0.0)
    total = reduce(lambda a, b: a + b, map(value, marks))
    return F.array_compact(F.array(F.when(F.abs(total - stated) > tolerance, F.lit("FAIL: the marks don't add up"))))
