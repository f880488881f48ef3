"""Candidate patterns: atoms over chains, their incidence, pairs, equivalence classes and evaluation.

An atom's mask is the set of chains it holds for. Here it is kept as rows (atom, chain), so
intersections are joins; operators.bitmaps packs it, which is the way to count many pairs.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators.storage import written
from eventloom.plans import rules

#: Thresholds of numeric atoms.
THRESHOLDS = {
    "count": (0, 1, 2, 3, 5, 10, 20),
    "day": (0, 7, 14, 30, 60, 90, 180, 365, 730, 1095, 1825),
    "sequence_gap": (1, 7, 14, 30, 60, 90, 180, 365),
    "ratio": (0, 0.25, 0.5, 0.75, 1),
    "density": (0, 0.5, 1, 2, 4, 8, 12, 24),
    "position": (1, 2, 3, 5, 10),
}
MIN_CHAINS, MIN_COMPANIES = 5, 5
#: Rules compiled into one projection; more would make the generated code too long.
RULES_AT_ONCE = 40


def selector(family: str, *types: str) -> dict:
    return {"scope": "middle_events", "family": family, "where": [{"field": "event.event_type", "cmp": "in", "value": sorted(types)}] if types else []}


def presence_atoms(types: list[tuple[str, str]], most: int = 8) -> list[dict]:
    """Presence and absence of each subset of a family's types, up to ``most`` types."""
    found = []
    for family in sorted({f for f, _ in types}):
        mine = sorted(t for f, t in types if f == family)
        for size in range(1, min(most, len(mine)) + 1):
            for chosen in combinations(mine, size):
                found += [{"op": op, "selector": selector(family, *chosen)} for op in ("present", "absent")]
    return found


def numeric_atoms(field: str, kind: str, low, high) -> list[dict]:
    """Comparisons of a field with the thresholds of its kind, inside the range that was observed."""
    return [{"op": "compare", "left": {"field": field}, "cmp": cmp, "right": {"literal": t}} for t in THRESHOLDS[kind] if low is not None and low <= t <= high for cmp in ("gte", "lte")]


def sequence_atoms(witnessed: list[tuple], gaps: bool = False) -> list[dict]:
    """Sequences of (family, type) tuples that occur; with gaps also with each least and largest distance."""
    found = []
    for steps in witnessed:
        base = {"op": "sequence", "steps": [selector(f, t) for f, t in steps], "ordering": "strict_before", "min_gap_days": None, "max_gap_days": None, "same_values": []}
        found.append(base)
        if gaps:
            found += [base | {"min_gap_days": g} for g in THRESHOLDS["sequence_gap"]] + [base | {"max_gap_days": g} for g in THRESHOLDS["sequence_gap"]]
    return found


def witnessed_pairs(events: DataFrame, key: str = "chain_id") -> DataFrame:
    """(first, second): types of events of one chain that lie strictly one after the other.

    No event is joined with another: the earliest end of each type meets the latest start of each.
    events: key, event_type, lo, hi.
    """
    edges = events.groupBy(key, "event_type").agg(F.min("hi").alias("hi"), F.max("lo").alias("lo"))
    a = edges.select(key, F.col("event_type").alias("first"), "hi")
    b = edges.select(key, F.col("event_type").alias("second"), F.col("lo").alias("lo2"))
    return a.join(b, key).filter(F.col("hi") < F.col("lo2")).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n_chains"))


def incidence(contexts: DataFrame, atoms: dict[str, dict]) -> DataFrame:
    """(atom, chain_id, company_id) for every chain that an atom's rule holds for. atoms: by identifier.

    Where there are more rules than fit one projection, the contexts are written first, so that they are built once.
    """
    out = None
    contexts = written(contexts) if len(atoms) > RULES_AT_ONCE else contexts
    names = list(atoms)
    for at in range(0, len(names), RULES_AT_ONCE):
        held = F.array_compact(F.array(*[F.when(rules.compile_rule(atoms[k]), F.lit(k)) for k in names[at : at + RULES_AT_ONCE]]))
        part = contexts.select(F.explode(held).alias("atom"), F.col("chain.chain_id").alias("chain_id"), F.col("chain.company_id").alias("company_id"))
        out = part if out is None else out.unionByName(part)
    return out


def supported(incident: DataFrame, n_chains: int, min_chains: int = MIN_CHAINS, min_companies: int = MIN_COMPANIES) -> DataFrame:
    """Atoms with enough chains and companies that don't hold everywhere: atom, n_chains, n_companies."""
    counts = incident.groupBy("atom").agg(F.count(F.lit(1)).alias("n_chains"), F.count_distinct("company_id").alias("n_companies"))
    return counts.filter((F.col("n_chains") >= min_chains) & (F.col("n_companies") >= min_companies) & (F.col("n_chains") < n_chains))


def shared(anchors: DataFrame, structural: DataFrame, anchor_facts: DataFrame | None = None, structural_facts: DataFrame | None = None) -> DataFrame:
    """(anchor, structural, chain_id, company_id): the chains that two atoms share; both sides are incidences.

    With the facts of both catalogues (atom and what compatibility() takes) pairs that say
    nothing new are left out.
    """
    b = structural.select(F.col("atom").alias("structural"), "chain_id")
    both = anchors.select(F.col("atom").alias("anchor"), "chain_id", "company_id")
    if anchor_facts is not None:
        both = both.join(anchor_facts.withColumnRenamed("atom", "anchor"), "anchor")
        b = b.join(structural_facts.withColumnRenamed("atom", "structural"), "structural")
    both = both.join(b, "chain_id")
    if anchor_facts is not None:
        both = compatibility(both).filter("reason IS NULL")
    return both.select("anchor", "structural", "chain_id", "company_id")


def pairs(anchors: DataFrame, structural: DataFrame, anchor_facts: DataFrame | None = None, structural_facts: DataFrame | None = None) -> DataFrame:
    """(anchor, structural, n_chains, n_companies) of pairs that share a chain, as shared() has them."""
    both = shared(anchors, structural, anchor_facts, structural_facts)
    return both.groupBy("anchor", "structural").agg(F.count(F.lit(1)).alias("n_chains"), F.count_distinct("company_id").alias("n_companies"))


#: Fields with a count that an anchor says something about, and what of it.
SCOPES = {"chain.n_exposure": "exposure", "chain.n_interface": "interface", "derived.n_middle": "total", "derived.n_known_date_middle_events": "dated", "derived.interface_investor_count": "participant"}


def compatibility(facts: DataFrame) -> DataFrame:
    """Adds reason: why a pair says nothing new (null: it may).

    facts: field, cmp, value of the structural atom; of the anchor: kind, family (of its type,
    null without one), count_min (map of total, exposure and interface to the least counts),
    dated_min, participant_min, typed_max (the most that its type may occur), needs_start.
    """
    value, cmp = F.col("value"), F.col("cmp")
    scope = F.lit(None).cast("string")
    for field, name in SCOPES.items():
        scope = F.when(F.col("field") == field, name).otherwise(scope)
    least = F.when(scope == "dated", F.col("dated_min")).when(scope == "participant", F.col("participant_min")).otherwise(F.coalesce(F.try_element_at("count_min", scope), F.lit(0)))
    of_type = scope.isin("total", "exposure", "interface")
    absent = (F.col("kind") == "absent") & (value == 0) & F.col("family").isNotNull() & ((scope == "total") | (scope == F.col("family")))
    reason = (
        F.when(scope.isNotNull() & (cmp == "lte") & (least > value), "UNSAT_COUNT_BOUND")
        .when(scope.isNotNull() & (cmp == "gte") & (least >= value), "ANCHOR_IMPLIES_STRUCTURAL")
        .when((cmp == "lte") & of_type & ((value <= F.col("typed_max")) | absent), "STRUCTURAL_IMPLIES_ANCHOR")
        .when((F.col("field") == "derived.chain_duration_days") & (cmp == "is_null") & F.col("needs_start"), "UNSAT_NULLNESS")
    )
    return facts.withColumn("reason", reason)


def allowed(spark: SparkSession, anchor_facts: DataFrame, structural: list[tuple]) -> dict[str, bytes]:
    """For each anchor (by its name, atom) a bit for each structural atom that compatibility() has nothing against, low bits first.

    structural: (field, cmp, value) in order; 1,000 of them are 125 bytes an anchor, which is what the driver gets.
    """
    table = F.from_json(F.lit(json.dumps([{"no": k, "field": f, "cmp": c, "value": v} for k, (f, c, v) in enumerate(structural)])), "array<struct<no:int,field:string,cmp:string,value:double>>")
    rows = compatibility(anchor_facts.select("*", F.inline(table))).filter("reason IS NULL")
    bits = rows.groupBy("atom").agg(F.substring(F.bitmap_construct_agg(F.col("no").cast("long")), 1, (len(structural) + 7) // 8).alias("bits"))
    return {r["atom"]: bytes(r["bits"]) for r in bits.collect()}


def representatives(catalog: DataFrame) -> DataFrame:
    """One atom for each track and mask: the lowest priority, then the first in canonical form.

    catalog: atom, track, mask, priority, canonical.
    """
    order = Window.partitionBy("track", "mask").orderBy("priority", "canonical")
    return catalog.withColumn("_n", F.row_number().over(order)).withColumn("n_members", F.count(F.lit(1)).over(Window.partitionBy("track", "mask"))).filter("_n = 1").drop("_n")


def evaluate(incident: DataFrame, labels: DataFrame) -> DataFrame:
    """The 2 x 2 table of each atom over all labelled companies. labels: company_id, label (SUCCESS or FAILURE)."""
    success = F.col("label") == "SUCCESS"
    known = labels.filter(F.col("label").isin("SUCCESS", "FAILURE"))
    total = known.agg(F.count_if(success).alias("all_success"), F.count_if(~success).alias("all_failure"))
    taking = incident.select("atom", "company_id").distinct().join(known, "company_id").groupBy("atom").agg(F.count_if(success).alias("success_taking"), F.count_if(~success).alias("failure_taking"))
    out = taking.crossJoin(F.broadcast(total))  # a single row
    return out.select(F.col("atom").alias("pattern"), "success_taking", "failure_taking", (F.col("all_success") - F.col("success_taking")).alias("success_not_taking"), (F.col("all_failure") - F.col("failure_taking")).alias("failure_not_taking"))


def same_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members (atom, chain_id) that only one of two incidences has; empty if a candidate covers its reference."""
    a, b = a.select("atom", "chain_id"), b.select("atom", "chain_id")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def review_matrix(reviewed: DataFrame) -> DataFrame:
    """Counts by result at three steps: all, after removals by policy, and one for each statistical signature.

    reviewed: pattern, result, reason (null: kept), signature, complexity.
    """
    kept = reviewed.filter(F.col("reason").isNull())
    first = Window.partitionBy("signature").orderBy("complexity", "pattern")
    single = kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    steps = [df.groupBy("result").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(name)) for df, name in ((reviewed, "1_all"), (kept, "2_after_policy"), (single, "3_representatives"))]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])
