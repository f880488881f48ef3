"""Queries on rules, patterns, prevalence and the candidate lattice."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventloom.operators import bitmaps, chains, compositions, context, freeze, generators, lattice, prevalence, review, sequences
from eventloom.operators.storage import shared_path, written
from eventloom.plans import analogues as a
from eventloom.plans import catalog_chains as base
from eventloom.plans import rules


def _members(spark, sf_dir, inside=None):
    """Events inside chains, as the context takes them; the participant is a name that repeats."""
    rows = base._middle(spark, sf_dir) if inside is None else inside
    ids = base._chains(spark, sf_dir).select("company_id", "chain_sequence", "chain_id")
    n = F.col("event_id").cast("long")
    return rows.join(ids, ["company_id", "chain_sequence"]).select(
        "chain_id",
        "event_id",
        "family",
        "event_type",
        F.lit(None).cast("string").alias("event_subtype"),
        "event_date",
        F.when(n % 3 == 0, F.concat(F.lit("i"), (n % 5).cast("string"))).alias("investor_id"),
        F.when(n % 3 == 1, F.concat(F.lit(" Firm  "), (n % 4).cast("string"))).alias("raw_investor_name"),
    )


def _contract(spark, sf_dir, inside=None):
    """Chains in the columns of the contract."""
    rows = a.events(spark, sf_dir).withColumn("event_date", F.col("day").cast("string"))
    made = chains.build_chains(a.outcomes(spark, sf_dir), rows.filter("family = 'exposure'"), rows.filter("family = 'interface'"), inside)
    empty = F.array().cast("array<string>")
    return made.select(
        "chain_id", "company_id", F.lit("SUCCESS").alias("company_label_v4"), "chain_sequence", "chain_start_date", F.lit("outcome").alias("chain_start_reason"),
        "chain_end_date", "chain_window_status", F.col("event_type").alias("outcome_type"), F.concat(F.lit("Series "), F.chr(F.lit(65) + F.col("company_id") % 3)).alias("outcome_round"),
        "n_participant_rows", "n_exposure", "n_interface", empty.alias("outcome_event_ids"),
        F.array(F.concat(F.lit("i"), (F.col("chain_sequence") % 4).cast("string"))).alias("investor_ids"), empty.alias("investor_raw_names"),
        "exposure_event_ids", "exposure_types", "interface_event_ids", "interface_types",
    )


def _contexts(spark, sf_dir):
    inside = written(base._middle(spark, sf_dir))
    return context.build(_contract(spark, sf_dir, inside), _members(spark, sf_dir, inside))


def _one(kind):
    return {"scope": "middle_events", "family": "any", "where": [{"field": "event.event_type", "cmp": "eq", "value": kind}]}


def _sequence(*types, low=None, high=None, same=()):
    return {"op": "sequence", "steps": [_one(t) for t in types], "ordering": "strict_before", "min_gap_days": low, "max_gap_days": high, "same_values": list(same)}


def _compare(left, cmp, literal):
    return {"op": "compare", "left": left, "cmp": cmp, "right": {"literal": literal}}


#: The patterns that the queries evaluate.
PATTERNS = {
    "view_no_error": {"op": "all", "rules": [{"op": "present", "selector": _one("view")}, {"op": "absent", "selector": _one("error")}]},
    "view_then_click": _sequence("view", "click"),
    "view_click_error": _sequence("view", "click", "error", low=1, high=14),
    "two_views": _sequence("view", "view"),
    "many_exposures": _compare({"field": "chain.n_exposure"}, "gte", 5),
    "signup_first": _compare({"event_position": {"selector": _one("signup"), "scope": "all_middle", "edge": "first_batch"}}, "eq", True),
    "late_click": _compare({"event_timing": {"selector": _one("click"), "relative_to": "end", "edge": "last", "bound": "min"}}, "lte", 1),
    "not_first": {"op": "not", "rule": _compare({"field": "derived.chain_position_bucket"}, "in", ["first"])},
    "several_people": _compare({"event_count": {"scope": "middle_events", "family": "any", "where": [{"field": "event.participant_key", "cmp": "not_null"}]}}, "gt", 3),
    "long_gap": _compare({"field": "derived.max_interbatch_gap_min"}, "gte", 3),
}


def pattern_set():
    patterns = [{"id": k, "name": k, "description": rules.render(r), "evaluation_status": "EVALUABLE", "not_evaluable_reason": None, "rule": r, "track": "ACTION_ELIGIBLE"} for k, r in PATTERNS.items()]
    return rules.check_pattern_set({"config_schema_version": "1.0", "pattern_set_id": "driver", "primary_order": list(PATTERNS), "patterns": patterns})


def _flags(spark, sf_dir):
    made = pattern_set()
    rows = _contexts(spark, sf_dir).select(F.col("chain.chain_id").alias("chain_id"), F.col("chain.company_id").alias("company_id"), F.col("chain.chain_sequence").alias("chain_sequence"), *rules.flags(made))
    return rows.withColumn("primary_seed", rules.primary(made))


def pattern_flags(spark, sf_dir):
    return _flags(spark, sf_dir).drop("chain_id")


def _single(name):
    def query(spark, sf_dir):
        return _contexts(spark, sf_dir).filter(rules.compile_rule(PATTERNS[name])).select(F.col("chain.company_id").alias("company_id"), F.col("chain.chain_sequence").alias("chain_sequence"))

    return query


def derived_features(spark, sf_dir):
    names = ("n_middle", "chain_duration_days", "n_ordered_batches", "n_comparable_gaps", "n_known_date_middle_events", "middle_span_min", "middle_span_max", "min_interbatch_gap_min", "max_interbatch_gap_max", "interface_share", "events_per_chain_year", "n_prior_chains", "chain_position_bucket", "first_any_after_start_min", "first_any_after_start_max", "last_any_before_end_min", "last_any_before_end_max", "interface_investor_count")
    return _contexts(spark, sf_dir).select(F.col("chain.company_id").alias("company_id"), F.col("chain.chain_sequence").alias("chain_sequence"), *[F.col(f"derived.{n}").alias(n) for n in names])


def _companies(spark, sf_dir):
    values = a.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company_id")).agg(F.count_if(F.col("event_type") == "signup").alias("s"), F.count_if(F.col("event_type") == "error").alias("e"))
    return values.select("company_id", F.when(F.col("s") > F.col("e"), "SUCCESS").when(F.col("s") < F.col("e"), "FAILURE").otherwise("AMBIGUOUS").alias("label"))


def company_profiles(spark, sf_dir):
    return prevalence.company_profiles(_companies(spark, sf_dir), _flags(spark, sf_dir), list(PATTERNS))


def pattern_prevalence(spark, sf_dir):
    return prevalence.two_by_two(company_profiles(spark, sf_dir), list(PATTERNS))


def action_value(spark, sf_dir):
    """Do customers of a segment order finished goods more often than others?"""
    orders = a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter("o_orderstatus IN ('F', 'O')")
    counts = orders.groupBy(F.col("c_mktsegment").alias("pattern")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("success_taking"), F.count_if(F.col("o_orderstatus") == "O").alias("failure_taking"))
    total = orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count_if(F.col("o_orderstatus") == "O").alias("f"))
    table = counts.crossJoin(F.broadcast(total)).select("pattern", "success_taking", "failure_taking", (F.col("s") - F.col("success_taking")).alias("success_not_taking"), (F.col("f") - F.col("failure_taking")).alias("failure_not_taking"))
    return prevalence.action_values(table)


def lattice_witnessed_pairs(spark, sf_dir):
    rows = chains.with_interval(base._middle(spark, sf_dir)).withColumn("chain", F.concat_ws("-", "company_id", "chain_sequence"))
    return lattice.witnessed_pairs(rows, "chain")


#: Presence and absence of the driver's event types.
TYPES = [(f, t) for f, ts in (("exposure", a.EXPOSURE), ("interface", a.INTERFACE)) for t in ts]
ATOMS = {f"{op}_{t}": rules.canonical({"op": op, "selector": lattice.selector(f, t)}) for f, t in TYPES for op in ("present", "absent")}
STRUCTURAL = {f"middle_{cmp}_{t}": _compare({"field": "derived.n_middle"}, cmp, t) for cmp in ("gte", "lte") for t in (1, 2, 5, 10)}


def _incidence(spark, sf_dir, atoms):
    return lattice.incidence(_contexts(spark, sf_dir), atoms)


def lattice_support(spark, sf_dir):
    total = _contract(spark, sf_dir).count()
    return lattice.supported(_incidence(spark, sf_dir, ATOMS | STRUCTURAL), total)


def lattice_pairs(spark, sf_dir):
    """Pairs of anchors and structural atoms that share a chain, without those that say nothing new, from packed masks."""
    contexts = bitmaps.numbered(_contexts(spark, sf_dir))
    anchors = generators.anchors(contexts, generators.observed_types(contexts), ("present", "absent"))
    short = {x.name: f"{x.kind}_{x.type[1]}" for x in anchors}
    masks = bitmaps.of_chains(contexts, {short[x.name]: x.rule for x in anchors} | STRUCTURAL)
    facts = generators.facts_frame(spark, anchors).replace(short, subset=["atom"])
    allowed = lattice.allowed(spark, facts, [(r["left"]["field"], r["cmp"], r["right"]["literal"]) for r in STRUCTURAL.values()])
    return bitmaps.pairs(contexts, masks, list(STRUCTURAL), allowed)


def lattice_masks(spark, sf_dir):
    """The digests of each atom's bits over chains and over companies, and how many are set."""
    contexts = bitmaps.numbered(_contexts(spark, sf_dir))
    n_chains, n_companies = contexts.agg(F.count(F.lit(1)), F.max("company_no")).first()
    of_chains = bitmaps.digests(bitmaps.of_chains(contexts, ATOMS | STRUCTURAL), n_chains)
    of_companies = bitmaps.digests(bitmaps.of_companies(contexts, ATOMS | STRUCTURAL), n_companies or 0)
    return of_chains.withColumnsRenamed({"sha256": "chain_mask_sha256", "n": "n_chains"}).join(of_companies.withColumnsRenamed({"sha256": "company_mask_sha256", "n": "n_companies"}), "atom")


#: Eight rules that formulas are put together from.
COMPOSED = {k: PATTERNS[k] for k in ("view_then_click", "many_exposures", "not_first", "long_gap")} | {k: ATOMS[k] for k in ("present_click", "present_error", "present_signup", "absent_view")}


def lattice_compositions(spark, sf_dir):
    return compositions.compose(bitmaps.numbered(_contexts(spark, sf_dir)), COMPOSED).drop("class")


def _frozen(spark, sf_dir):
    """A generation frozen over the driver's events, loaded again, and the contexts."""
    contexts = written(_contexts(spark, sf_dir))
    anchors = generators.anchors(contexts, generators.observed_types(contexts), ("present", "absent"))
    structural = generators.structural(contexts, ("derived.n_middle",), rounds=False)
    inputs, path = {"events": a.table(spark, sf_dir, "events")}, shared_path(spark, "frozen-")
    freeze.freeze(contexts, anchors, structural, inputs, path, "label")
    return freeze.load(spark, path, inputs), contexts


def freeze_evaluation(spark, sf_dir):
    """Every frozen pair with its support and its action values; labels are joined after the freeze."""
    tables, contexts = _frozen(spark, sf_dir)
    return freeze.evaluate(tables, contexts, _companies(spark, sf_dir)).drop("atom", "representative", "mask", "anchor_dimension", "structural_dimension")


#: Rules that the frozen candidates are held against.
REFERENCES = {"views": ATOMS["present_view"], "no_errors": ATOMS["absent_error"], "view_no_error": PATTERNS["view_no_error"], "clicks_of_five": {"op": "all", "rules": [ATOMS["present_click"], STRUCTURAL["middle_gte_5"]]}, "two_views": PATTERNS["two_views"]}


def freeze_coverage(spark, sf_dir):
    """Which rules have a frozen atom or pair with the very same companies."""
    return freeze.coverage(*_frozen(spark, sf_dir), REFERENCES)


#: Sequences that are matched over exploded rows.
SEQUENCES = {"short_steps": _sequence("view", "click", "error", low=1, high=14), "one_person": _sequence("view", "view", "view", same=("event.participant_key",)), "quick": _sequence("click", "view", high=2)}


def sequence_matches(spark, sf_dir):
    """The chains of each sequence, without an array of events."""
    n = F.col("event_id").cast("long")
    person = F.when(n % 3 == 0, F.concat(F.lit("id:i"), (n % 5).cast("string"))).when(n % 3 == 1, F.concat(F.lit("raw:firm "), (n % 4).cast("string")))
    rows = written(chains.with_interval(base._middle(spark, sf_dir)).select(F.struct("company_id", "chain_sequence").alias("chain"), "family", "event_type", person.alias("participant_key"), "lo", "hi"))
    found = [sequences.matches(rows, rule, "chain").select(F.lit(name).alias("rule"), "chain.company_id", "chain.chain_sequence") for name, rule in SEQUENCES.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: A rule's text for each line item, with values of its columns; SQL that both engines read.
_FIRST = """'{"op":"present","selector":{"family":"any","scope":"middle_events","where":[{"cmp":"eq","field":"event.event_type","value":"' || CASE l_partkey % 7 WHEN 0 THEN 'exit' WHEN 1 THEN ' Other ' ELSE 'type_' || CAST(l_partkey % 7 AS VARCHAR(9)) END || '"}]}}'"""
_OF_FIELD = """'{"cmp":"' || {cmp} || '","left":{"field":"' || {field} || '"},"op":"compare"' || {right} || '}'"""
_SECOND = " ".join(
    f"WHEN {k} THEN {sql}"
    for k, sql in enumerate(
        [
            _OF_FIELD.replace("{cmp}", "'gte'").replace("{field}", "'derived.n_middle'").replace("{right}", "',\"right\":{\"literal\":' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || '}'"),
            _OF_FIELD.replace("{cmp}", "'in'").replace("{field}", "'derived.outcome_round_bucket'").replace("{right}", "',\"right\":{\"literal\":[\"seed\",\"' || CASE l_returnflag WHEN 'A' THEN 'unknown' WHEN 'N' THEN 'series_a' ELSE 'Other' END || '\"]}'"),
            """'{"cmp":"lte","left":{"event_timing":{"bound":"min","edge":"last","relative_to":"' || CASE l_linestatus WHEN 'O' THEN 'end' ELSE 'start' END || '","selector":{"family":"any","scope":"middle_events","where":[]}}},"op":"compare","right":{"literal":7}}'""",
            _OF_FIELD.replace("{cmp}", "'lte'").replace("{field}", "CASE l_returnflag WHEN 'A' THEN 'derived.chain_duration_days' WHEN 'N' THEN 'derived.company_chain_count' ELSE 'derived.interface_investor_basis' END").replace("{right}", "',\"right\":{\"literal\":3}'"),
            _OF_FIELD.replace("{cmp}", "'eq'").replace("{field}", "CASE l_linestatus WHEN 'O' THEN 'chain.outcome_type' ELSE 'chain.n_exposure' END").replace("{right}", "',\"right\":{\"literal\":null}'"),
            _OF_FIELD.replace("{cmp}", "CASE l_returnflag WHEN 'A' THEN 'is_null' WHEN 'N' THEN 'not_null' ELSE 'gte' END").replace("{field}", "'derived.middle_span_min'").replace("{right}", "CASE WHEN l_returnflag IN ('A', 'N') THEN '' ELSE ',\"right\":{\"literal\":1}' END"),
        ],
        1,
    )
)
_RULE = f"""CASE WHEN l_suppkey % 97 = 0 THEN NULL ELSE '{{"op":"' || op || '","rules":[' || {_FIRST} || ',' || CASE l_linenumber {_SECOND} ELSE '["' || lower(l_returnflag) || '"]' END || ']}}' END"""


def policy_review(spark, sf_dir):
    """The reason to remove, or null, and the complexity of two rules for each line item."""
    rows = a.table(spark, sf_dir, "lineitem").withColumn("op", F.explode(F.array(F.lit("all"), F.lit("any"))))
    dimension = F.when(F.col("l_discount") == 0.10, "duration").otherwise("count")
    pairs = rows.select(
        "l_orderkey", "l_linenumber", "op", F.expr(_RULE).alias("rule"), F.when(F.col("l_discount") == 0.01, F.array(F.lit("future"))).alias("taints"), F.lit("typed_presence").alias("event_dimension"),
        F.when(F.col("l_tax") == 0.08, "typed_count").otherwise("typed_presence").alias("anchor_dimension"), dimension.alias("structural_dimension"), F.when(F.col("l_suppkey") % 89 > 0, dimension).alias("component_dimension"),
    )
    return review.reviewed(pairs).select("l_orderkey", "l_linenumber", "op", "reason", "complexity")


def lattice_catalog(spark, sf_dir):
    """Atoms as they are generated from the chains, with their support: anchors, sequences without gaps, and structural ones."""
    contexts = written(_contexts(spark, sf_dir))
    types = generators.observed_types(contexts)
    atoms = generators.anchors(contexts, types, ("present", "absent", "count", "position"))
    events = contexts.select(F.col("chain.chain_id").alias("chain_id"), F.explode("events").alias("e")).select("chain_id", "e.family", "e.event_type", "e.lo", "e.hi")
    atoms += generators.sequences([r[0] for r in generators.witnessed(events, 2).select("tuple").collect()], gaps=False)  # MOST_TYPES squared at most
    atoms += generators.structural(contexts, ("chain.n_exposure", "chain.n_interface", "derived.n_middle", "derived.n_ordered_batches", "derived.n_prior_chains"), rounds=False)
    atoms = [x for x in atoms if "same" not in x.name.split()]
    incident = lattice.incidence(contexts, {x.name: x.rule for x in atoms})
    return incident.groupBy("atom").agg(F.count(F.lit(1)).alias("n_chains"), F.count_distinct("company_id").alias("n_companies"))


def lattice_witnessed_triples(spark, sf_dir):
    rows = chains.with_interval(base._middle(spark, sf_dir)).withColumn("chain_id", F.concat_ws("-", "company_id", "chain_sequence"))
    return generators.witnessed(rows, 3).select(F.array_join("tuple", ">").alias("tuple"), "n_chains")


def mask_representatives(spark, sf_dir):
    """One atom for each set of companies, told by the digest of its bits."""
    contexts = bitmaps.numbered(_contexts(spark, sf_dir))
    digests = bitmaps.digests(bitmaps.of_companies(contexts, ATOMS | STRUCTURAL), contexts.agg(F.max("company_no")).first()[0] or 0)
    known = {k: rules.canonical_json(rules.canonical(r)) for k, r in (ATOMS | STRUCTURAL).items()}
    catalog = spark.createDataFrame([(k, "ACTION_ELIGIBLE", rules.complexity(json.loads(c)), c) for k, c in known.items()], "atom string, track string, priority int, canonical string")
    return lattice.representatives(digests.select("atom", F.col("sha256").alias("mask")).join(F.broadcast(catalog), "atom")).select("atom", "mask", "n_members")


def lattice_evaluation(spark, sf_dir):
    return prevalence.action_values(lattice.evaluate(_incidence(spark, sf_dir, ATOMS), _companies(spark, sf_dir)))


def mask_equality(spark, sf_dir):
    """present and not absent have one mask; the chains in which a view is there but no click, or a click but no view, are on one side only."""
    contexts = written(_contexts(spark, sf_dir))
    left = lattice.incidence(contexts, {"same": ATOMS["present_view"], "differ": ATOMS["present_view"]})
    right = lattice.incidence(contexts, {"same": {"op": "not", "rule": ATOMS["absent_view"]}, "differ": ATOMS["present_click"]})
    return lattice.same_masks(left, right).groupBy("atom", "side").agg(F.count(F.lit(1)).alias("n"))


def compatibility(spark, sf_dir):
    """Every arm, for each of the five fields with a count and one without."""
    k, size = F.col("p_partkey"), F.col("p_size")
    fields = F.array(*map(F.lit, (*lattice.SCOPES, "derived.chain_duration_days", "derived.n_prior_chains")))
    rows = a.table(spark, sf_dir, "part").select(
        k.alias("pair_id"),
        F.element_at(fields, (k % 7 + 1).cast("int")).alias("field"),
        F.when((k % 7 == 5) & (size % 2 == 0), "is_null").when(F.floor(k / 7) % 2 == 0, "lte").otherwise("gte").alias("cmp"),
        (size % 6).cast("double").alias("value"),
        F.when(k % 4 == 0, "absent").otherwise("count").alias("kind"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "interface").otherwise("exposure").alias("family"),
        F.create_map(F.lit("total"), (k % 4).cast("int"), F.lit("exposure"), (k % 3).cast("int")).alias("count_min"),
        (k % 2).cast("int").alias("dated_min"),
        (k % 5).cast("int").alias("participant_min"),
        F.when(k % 3 == 0, (k % 5).cast("int")).alias("typed_max"),
        (k % 2 == 0).alias("needs_start"),
    )
    return lattice.compatibility(rows).select("pair_id", "reason")


def review_matrix(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pattern"),
        F.when(F.col("p_size") < 10, "RECOMMEND").when(F.col("p_size") < 30, "INDIFFERENT").otherwise("INCONCLUSIVE").alias("result"),
        F.when(F.col("p_type") == "ECONOMY", "policy").alias("reason"),
        F.concat_ws("|", "p_brand", "p_size").alias("signature"),
        (F.col("p_partkey") % 9).alias("complexity"),
    )
    return lattice.review_matrix(rows)


def pattern_registry(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("pattern_id"), F.when(F.col("p_size") % 2 == 0, "ACTION_ELIGIBLE").otherwise("DESCRIPTIVE_ASSOCIATION").alias("track"), F.when(F.col("p_size") > 25, "RECOMMEND").otherwise("AVOID").alias("result"))
    half = F.substring("pattern_id", 2, 9).cast("int") % 2 == 0
    return prevalence.registry(rows.filter(half), rows.filter(~half)).groupBy("result").agg(F.count(F.lit(1)).alias("n"))


_CX = base._MIDDLE
_HAS = lambda kind: f"EXISTS (SELECT 1 FROM mid m WHERE m.company_id = ch.company_id AND m.chain_sequence = ch.chain_sequence AND m.event_type = '{kind}')"
_OF = "{0}.company_id = ch.company_id AND {0}.chain_sequence = ch.chain_sequence"
_BASE = f"""{_CX}, cnt AS (SELECT ch.company_id, ch.chain_sequence, count(mid.event_id) AS n_middle, count(*) FILTER (family = 'exposure') AS n_exposure, count(*) FILTER (family = 'interface') AS n_interface FROM ch LEFT JOIN mid USING (company_id, chain_sequence) GROUP BY ALL)"""
_SEQ2 = lambda x, y: f"EXISTS (SELECT 1 FROM mid m1, mid m2 WHERE {_OF.format('m1')} AND {_OF.format('m2')} AND m1.event_type = '{x}' AND m2.event_type = '{y}' AND m1.hi < m2.lo)"
_RULE_SQL = {
    "view_no_error": f"{_HAS('view')} AND NOT {_HAS('error')}",
    "view_then_click": _SEQ2("view", "click"),
    "view_click_error": f"""EXISTS (SELECT 1 FROM mid m1, mid m2, mid m3 WHERE {_OF.format('m1')} AND {_OF.format('m2')} AND {_OF.format('m3')} AND m1.event_type = 'view' AND m2.event_type = 'click' AND m3.event_type = 'error'
      AND m1.hi < m2.lo AND m2.hi < m3.lo AND m2.lo - m1.hi >= 1 AND m3.lo - m2.hi >= 1 AND m2.hi - m1.lo <= 14 AND m3.hi - m2.lo <= 14)""",
    "two_views": _SEQ2("view", "view"),
    "many_exposures": "cnt.n_exposure >= 5",
    "signup_first": f"EXISTS (SELECT 1 FROM bt WHERE {_OF.format('bt')} AND event_type = 'signup' AND batch = 1)",
    "late_click": f"""coalesce((SELECT min(ch.end_day - hi) <= 1 FROM mid m, (SELECT min(lo) AS lim FROM mid m0 WHERE {_OF.format('m0')} AND event_type = 'click' AND hi = (SELECT max(hi) FROM mid mx WHERE {_OF.format('mx')} AND event_type = 'click')) l
      WHERE {_OF.format('m')} AND event_type = 'click' AND hi >= lim), false)""",
    "not_first": "ch.chain_sequence > 1",
    "several_people": f"(SELECT count(*) FROM mid m WHERE {_OF.format('m')} AND event_id::BIGINT % 3 < 2) > 3",
    "long_gap": f"coalesce((SELECT max(g) >= 3 FROM (SELECT min(lo) - lag(max(hi)) OVER (ORDER BY batch) AS g FROM bt WHERE {_OF.format('bt')} GROUP BY batch)), false)",
}
_JOIN = "FROM ch JOIN cnt USING (company_id, chain_sequence)"
_FLAGS = f"{_BASE}, fl AS (SELECT ch.company_id, ch.chain_sequence, {', '.join(f'({sql}) AS {name}' for name, sql in _RULE_SQL.items())} {_JOIN})"
_PRIMARY = "CASE " + " ".join(f"WHEN {n} THEN '{n}'" for n in PATTERNS) + " ELSE 'UNMATCHED' END"
_COMPANIES = "co AS (SELECT user_id AS company_id, CASE WHEN s > e THEN 'SUCCESS' WHEN s < e THEN 'FAILURE' ELSE 'AMBIGUOUS' END AS label FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id))"
_PROFILES = f"{_FLAGS}, {_COMPANIES}, pf AS (SELECT company_id, label, count(fl.chain_sequence) AS n_chains, {', '.join(f'CASE WHEN count(fl.chain_sequence) > 0 THEN count(*) FILTER ({n}) END AS {n}_count, bool_or({n}) AS {n}_any' for n in PATTERNS)} FROM co LEFT JOIN fl USING (company_id) GROUP BY ALL)"
_VALUES = """v AS (SELECT *, success_taking + failure_taking AS n1, success_not_taking + failure_not_taking AS n0, success_taking + success_not_taking AS s, failure_taking + failure_not_taking AS f FROM t),
      w AS (SELECT *, success_taking / nullif(n1, 0) AS p1, success_not_taking / nullif(n0, 0) AS p0, CASE WHEN n1 = 0 OR n0 = 0 THEN NULL WHEN s = 0 OR f = 0 THEN 0.0::DOUBLE ELSE (n1 + n0) * pow(success_taking * failure_not_taking - failure_taking * success_not_taking, 2) / (n1::DOUBLE * n0 * s * f) END AS x FROM v),
      z AS (SELECT *, sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS se FROM w)
      SELECT pattern, success_taking, failure_taking, success_not_taking, failure_not_taking, p1 AS taking_success_rate, p0 AS not_taking_success_rate, p1 - p0 AS ate_success, x AS chi_square,
      CASE WHEN n1 = 0 OR n0 = 0 THEN 'INSUFFICIENT_PATTERN_SUPPORT' WHEN x > 3.841458820694124 THEN CASE WHEN p1 > p0 THEN 'RECOMMEND' WHEN p1 < p0 THEN 'AVOID' ELSE 'INDIFFERENT' END
        WHEN CASE WHEN se = 0 THEN abs(p1 - p0) < 0.05 ELSE (p1 - p0 + 0.05) / se > 1.6448536269514722 AND (p1 - p0 - 0.05) / se < -1.6448536269514722 END THEN 'INDIFFERENT' ELSE 'INCONCLUSIVE' END AS result FROM z"""
_ATOMS = " UNION ALL ".join([f"SELECT '{op}_{k}' AS atom, ch.company_id, ch.chain_sequence FROM ch WHERE {'NOT ' if op == 'absent' else ''}{_HAS(k)}" for op in ("present", "absent") for k in ("view", "click", "error", "signup")])
_STRUCT = " UNION ALL ".join([f"SELECT 'middle_{c}_{t}' AS atom, company_id, chain_sequence FROM cnt WHERE n_middle {'>=' if c == 'gte' else '<='} {t}" for c in ("gte", "lte") for t in (1, 2, 5, 10)])
_INC = f"{_BASE}, an AS ({_ATOMS}), st AS ({_STRUCT}), al AS (SELECT * FROM an UNION ALL SELECT * FROM st)"
#: Chains and companies by number from 0, and the bytes of each atom's bits as hexadecimal digits: of chains (x = i), of companies (x = c).
_NUMBERS = "nu AS (SELECT company_id, chain_sequence, row_number() OVER (ORDER BY company_id, chain_sequence) - 1 AS i, dense_rank() OVER (ORDER BY company_id) - 1 AS c FROM ch)"
_BYTES = lambda name, x: f"""{name}_b AS (SELECT atom, x // 8 AS b, sum(1 << (x % 8)::INT) AS v FROM (SELECT DISTINCT atom, {x} AS x FROM al JOIN nu USING (company_id, chain_sequence)) GROUP BY 1, 2),
  {name} AS (SELECT atom, sha256(unhex(string_agg(printf('%02x', coalesce(v, 0)::INT), '' ORDER BY b))) AS sha, sum(bit_count(coalesce(v, 0)::INT))::BIGINT AS n
    FROM (SELECT DISTINCT atom FROM {name}_b) CROSS JOIN (SELECT unnest(range((SELECT max({x}) FROM nu) // 8 + 1)) AS b) LEFT JOIN {name}_b USING (atom, b) GROUP BY atom)"""  # noqa: E731
_PRIORITY = ", ".join(f"('{k}', {rules.complexity(rules.canonical(r))}, '{rules.canonical_json(rules.canonical(r))}')" for k, r in (ATOMS | STRUCTURAL).items())


#: Each chain as a number with a bit for each composed rule that holds; formulas as two such numbers.
_COMPOSED_BITS = " + ".join(f"CASE WHEN {sql} THEN {1 << k} ELSE 0 END" for k, sql in enumerate({"absent_view": f"NOT {_HAS('view')}", "long_gap": _RULE_SQL["long_gap"], "many_exposures": _RULE_SQL["many_exposures"], "not_first": _RULE_SQL["not_first"], **{f"present_{t}": _HAS(t) for t in ("click", "error", "signup")}, "view_then_click": _RULE_SQL["view_then_click"]}.values()))
_COMPOSITIONS_SQL = f"""{_BASE}, m AS MATERIALIZED (SELECT ch.company_id, ({_COMPOSED_BITS})::INT AS m {_JOIN}), d AS MATERIALIZED (SELECT m, count(*) AS n FROM m GROUP BY m), dc AS MATERIALIZED (SELECT DISTINCT m, company_id FROM m),
  names(k, name) AS (VALUES {", ".join(f"({k}, '{name}')" for k, name in enumerate(sorted(COMPOSED)))}),
  u AS (SELECT coalesce(bit_or(1 << k), 0)::INT AS ok FROM names WHERE (SELECT sum(n) FROM d WHERE m & (1 << k) > 0) >= 5 AND (SELECT count(DISTINCT company_id) FROM dc WHERE m & (1 << k) > 0) >= 5),
  e AS (SELECT x::INT AS e FROM range(256) r(x), u WHERE x & ~ok = 0 AND bit_count(x::INT) <= 4), s AS (SELECT x::INT AS s FROM range(256) r(x), u WHERE x & ~ok = 0 AND (x = 0 OR bit_count(x::INT) IN (2, 3) AND (SELECT sum(n) FROM d WHERE m & x > 0) < (SELECT sum(n) FROM d))),
  f AS MATERIALIZED (SELECT e, s FROM e, s WHERE e & s = 0 AND e + s > 0 AND bit_count(e) + (s > 0)::INT <= 4),
  g AS MATERIALIZED (SELECT e, s, sum(n)::BIGINT AS n, string_agg(m::VARCHAR, ',' ORDER BY m) AS cls FROM f JOIN d ON m & e = e AND (s = 0 OR m & s > 0) GROUP BY e, s),
  h AS (SELECT g.e, g.s, any_value(n) AS n, any_value(cls) AS cls, count(DISTINCT company_id) AS nc FROM g JOIN dc ON m & e = e AND (s = 0 OR m & s > 0) WHERE n >= 5 AND n < (SELECT sum(n) FROM d) GROUP BY g.e, g.s),
  w AS (SELECT *, bit_count(e) + bit_count(s) AS n_atoms, (SELECT string_agg(name, ' & ' ORDER BY k) FROM names WHERE e & (1 << k) > 0) AS te, (SELECT string_agg(name, ' | ' ORDER BY k) FROM names WHERE s & (1 << k) > 0) AS ts FROM h WHERE nc >= 5),
  z AS (SELECT *, CASE WHEN ts IS NULL THEN te WHEN te IS NULL THEN ts ELSE te || ' & (' || ts || ')' END AS formula FROM w)
  SELECT formula, n_atoms::INT AS n_atoms, n AS n_chains, nc AS n_companies, first_value(formula) OVER (PARTITION BY cls ORDER BY n_atoms, formula) AS representative FROM z"""
#: The frozen atoms (fa: rows, sa: supported ones) and pairs (pc: rows, pr: supported ones).
_FROZEN_SQL = f"""{_BASE}, fn AS ({" UNION ALL ".join(f"SELECT '{f}:{t} {op}' AS atom, '{op}' AS kind, ch.company_id, ch.chain_sequence FROM ch WHERE {'NOT ' if op == 'absent' else ''}{_HAS(t)}" for f, t in TYPES for op in ("present", "absent"))}),
  fs AS (SELECT 'derived.n_middle ' || cmp || ' ' || t AS atom, cmp, t, company_id, chain_sequence FROM cnt, (VALUES ('gte'), ('lte')) AS c(cmp), (SELECT unnest({list(lattice.THRESHOLDS["count"])}) AS t) WHERE t BETWEEN (SELECT min(n_middle) FROM cnt) AND (SELECT max(n_middle) FROM cnt) AND CASE WHEN cmp = 'gte' THEN n_middle >= t ELSE n_middle <= t END),
  fa AS (SELECT atom, company_id, chain_sequence FROM fn UNION ALL SELECT atom, company_id, chain_sequence FROM fs), sa AS (SELECT atom FROM fa GROUP BY atom HAVING count(*) >= 5 AND count(DISTINCT company_id) >= 5 AND count(*) < (SELECT count(*) FROM ch)),
  pc AS (SELECT fn.atom || ' & ' || fs.atom AS pair, fn.atom AS anchor, fs.atom AS structural, fn.company_id, fn.chain_sequence FROM fn JOIN fs USING (company_id, chain_sequence)
    WHERE fn.atom IN (SELECT atom FROM sa) AND fs.atom IN (SELECT atom FROM sa) AND NOT (CASE WHEN kind = 'present' THEN CASE WHEN cmp = 'lte' THEN t < 1 ELSE t <= 1 END ELSE t = 0 END)),
  pr AS (SELECT pair, any_value(anchor) AS anchor, any_value(structural) AS structural, count(*) AS n_chains, count(DISTINCT company_id) AS n_companies FROM pc GROUP BY pair HAVING count(*) >= 5 AND count(DISTINCT company_id) >= 5 AND count(*) < (SELECT count(*) FROM ch))"""
_REFERENCE_SQL = "rf AS (" + " UNION ALL ".join(f"SELECT '{name}' AS reference, ch.company_id {_JOIN} WHERE {sql}" for name, sql in {"views": _HAS("view"), "no_errors": f"NOT {_HAS('error')}", "view_no_error": _RULE_SQL["view_no_error"], "clicks_of_five": f"{_HAS('click')} AND cnt.n_middle >= 5", "two_views": _RULE_SQL["two_views"]}.items()) + ")"


_FAM = {t: f for f, t in TYPES}
_N = lambda t: f"count(*) FILTER (family = '{_FAM[t]}' AND ft.event_type = '{t}')"
#: Per chain: events by type, whether a type is in the first or last batch (of all, and of its family), sequences, and totals.
_CATALOG_SQL = f"""{_CX}, fb AS (SELECT *, sum(CASE WHEN fr IS NULL OR lo > fr THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, chain_sequence, family ORDER BY lo, hi, event_type, event_id ROWS UNBOUNDED PRECEDING) AS family_batch
    FROM (SELECT *, max(hi) OVER (PARTITION BY company_id, chain_sequence, family ORDER BY lo, hi, event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fr FROM bt)),
  ft AS (SELECT *, max(batch) OVER c AS last_all, max(family_batch) OVER (PARTITION BY company_id, chain_sequence, family) AS last_family FROM fb WINDOW c AS (PARTITION BY company_id, chain_sequence)),
  t AS (SELECT ch.company_id, ch.chain_sequence, count(event_id) AS m, count(*) FILTER (family = 'exposure') AS ne, count(*) FILTER (family = 'interface') AS ni, coalesce(max(last_all), 0) AS nb, ch.chain_sequence - 1 AS np,
    {", ".join(f"{_N(t)} AS n_{t}, min(hi) FILTER (ft.event_type = '{t}') AS h_{t}, max(lo) FILTER (ft.event_type = '{t}') AS l_{t}, coalesce(bool_or(batch = 1) FILTER (ft.event_type = '{t}'), false) AS fa_{t}, coalesce(bool_or(batch = last_all) FILTER (ft.event_type = '{t}'), false) AS la_{t}, coalesce(bool_or(family_batch = 1) FILTER (ft.event_type = '{t}'), false) AS ff_{t}, coalesce(bool_or(family_batch = last_family) FILTER (ft.event_type = '{t}'), false) AS lf_{t}" for _, t in TYPES)}
    FROM ch LEFT JOIN ft USING (company_id, chain_sequence) GROUP BY ch.company_id, ch.chain_sequence),
  x AS ({" UNION ALL ".join(
    [f"SELECT company_id, '{f}:{t} {name}' AS atom FROM t WHERE {test}" for f, t in TYPES for name, test in [("present", f"n_{t} > 0"), ("absent", f"n_{t} = 0"), *[(f"count gte {n}", f"n_{t} >= {n} AND (SELECT max(n_{t}) FROM t) >= {n}") for n in generators.COUNT_AT_LEAST], *[(f"count lte {n}", f"n_{t} <= {n}") for n in generators.COUNT_AT_MOST], ("family first_batch", f"ff_{t}"), ("family last_batch", f"lf_{t}"), ("all_middle first_batch", f"fa_{t}"), ("all_middle last_batch", f"la_{t}")]]
    + [f"SELECT company_id, '{f1}:{t1} > {f2}:{t2}' FROM t WHERE h_{t1} < l_{t2}" for f1, t1 in TYPES for f2, t2 in TYPES]
    + [f"SELECT company_id, '{field} {cmp} {n}' FROM t WHERE {c} {'>=' if cmp == 'gte' else '<='} {n} AND {n} BETWEEN (SELECT min({c}) FROM t) AND (SELECT max({c}) FROM t)" for field, c, grid, cmps in (("chain.n_exposure", "ne", "count", ("gte", "lte")), ("chain.n_interface", "ni", "count", ("gte", "lte")), ("derived.n_middle", "m", "count", ("gte", "lte")), ("derived.n_ordered_batches", "nb", "count", ("gte",)), ("derived.n_prior_chains", "np", "position", ("gte",))) for n in lattice.THRESHOLDS[grid] for cmp in cmps]
  )})
  SELECT atom, count(*) AS n_chains, count(DISTINCT company_id) AS n_companies FROM x GROUP BY atom"""


QUERIES = {
    "pattern_flags": (pattern_flags, f"{_FLAGS} SELECT *, {_PRIMARY} AS primary_seed FROM fl"),
    **{f"pattern_{name}": (_single(name), f"{_FLAGS} SELECT company_id, chain_sequence FROM fl WHERE {name}") for name in ("view_no_error", "view_then_click", "view_click_error", "late_click", "signup_first")},
    "derived_features": (derived_features, f"""{_BASE}, b AS (SELECT company_id, chain_sequence, batch, min(lo) AS lo, max(hi) AS hi FROM bt GROUP BY ALL),
      g AS (SELECT *, lo - lag(hi) OVER w AS g1, hi - lag(lo) OVER w AS g2 FROM b WINDOW w AS (PARTITION BY company_id, chain_sequence ORDER BY batch)),
      gs AS (SELECT company_id, chain_sequence, count(*) AS nb, (max_by(lo, batch) - min_by(hi, batch))::INT AS s1, (max_by(hi, batch) - min_by(lo, batch))::INT AS s2, min(g1)::INT AS g1, max(g2)::INT AS g2 FROM g GROUP BY ALL),
      tm AS (SELECT mid.*, ch.start_day, ch.end_day, min(lo) OVER k AS e_lo, max(hi) OVER k AS e_hi FROM mid JOIN ch USING (company_id, chain_sequence) WINDOW k AS (PARTITION BY mid.company_id, mid.chain_sequence)),
      tl AS (SELECT *, max(hi) FILTER (lo = e_lo) OVER k AS f_lim, min(lo) FILTER (hi = e_hi) OVER k AS l_lim FROM tm WINDOW k AS (PARTITION BY company_id, chain_sequence)),
      tt AS (SELECT company_id, chain_sequence, min(lo - start_day) FILTER (lo <= f_lim)::INT AS a1, max(hi - start_day) FILTER (lo <= f_lim)::INT AS a2, min(end_day - hi) FILTER (hi >= l_lim)::INT AS b1, max(end_day - lo) FILTER (hi >= l_lim)::INT AS b2,
        count(DISTINCT CASE event_id::BIGINT % 3 WHEN 0 THEN 'id:i' || event_id::BIGINT % 5 WHEN 1 THEN 'raw:firm ' || event_id::BIGINT % 4 END) FILTER (family = 'interface') AS people FROM tl GROUP BY ALL)
      SELECT ch.company_id, ch.chain_sequence, n_middle, (end_day - start_day)::INT AS chain_duration_days, coalesce(nb, 0) AS n_ordered_batches, greatest(coalesce(nb, 0) - 1, 0) AS n_comparable_gaps, n_middle::INT AS n_known_date_middle_events,
        CASE WHEN nb > 1 THEN s1 END AS middle_span_min, CASE WHEN nb > 1 THEN s2 END AS middle_span_max, g1 AS min_interbatch_gap_min, g2 AS max_interbatch_gap_max, CASE WHEN n_middle > 0 THEN n_interface / n_middle END AS interface_share,
        CASE WHEN end_day > start_day THEN n_middle * 365.25::DOUBLE / (end_day - start_day) END AS events_per_chain_year, ch.chain_sequence - 1 AS n_prior_chains,
        CASE WHEN ch.chain_sequence = 1 THEN 'first' WHEN ch.chain_sequence = max(ch.chain_sequence) OVER (PARTITION BY ch.company_id) THEN 'last' WHEN ch.chain_sequence <= 3 THEN 'early' ELSE 'later' END AS chain_position_bucket,
        a1 AS first_any_after_start_min, a2 AS first_any_after_start_max, b1 AS last_any_before_end_min, b2 AS last_any_before_end_max, coalesce(people, 0)::INT AS interface_investor_count
      FROM ch JOIN cnt USING (company_id, chain_sequence) LEFT JOIN gs USING (company_id, chain_sequence) LEFT JOIN tt USING (company_id, chain_sequence)"""),
    "company_profiles": (company_profiles, f"{_PROFILES} SELECT * FROM pf"),
    "pattern_prevalence": (pattern_prevalence, f"""{_PROFILES}, l AS ({" UNION ALL ".join(f"SELECT '{n}' AS pattern, label, {n}_any AS t FROM pf WHERE n_chains > 0" for n in PATTERNS)})
      SELECT pattern, count(*) FILTER (t AND label = 'SUCCESS') AS success_taking, count(*) FILTER (t AND label = 'FAILURE') AS failure_taking, count(*) FILTER (NOT t AND label = 'SUCCESS') AS success_not_taking, count(*) FILTER (NOT t AND label = 'FAILURE') AS failure_not_taking
      FROM l WHERE label IN ('SUCCESS', 'FAILURE') GROUP BY pattern"""),
    "action_value": (action_value, f"""WITH o AS (SELECT c_mktsegment AS pattern, count(*) FILTER (o_orderstatus = 'F') AS success_taking, count(*) FILTER (o_orderstatus = 'O') AS failure_taking FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
      t AS (SELECT *, (SELECT sum(success_taking) FROM o)::BIGINT - success_taking AS success_not_taking, (SELECT sum(failure_taking) FROM o)::BIGINT - failure_taking AS failure_not_taking FROM o), {_VALUES}"""),
    "lattice_witnessed_pairs": (lattice_witnessed_pairs, f"""{_CX} SELECT x.event_type AS first, y.event_type AS second, count(DISTINCT (x.company_id, x.chain_sequence)) AS n_chains FROM mid x JOIN mid y USING (company_id, chain_sequence) WHERE x.hi < y.lo GROUP BY ALL"""),
    "lattice_support": (lattice_support, f"{_INC} SELECT atom, count(*) AS n_chains, count(DISTINCT company_id) AS n_companies FROM al GROUP BY atom HAVING count(*) >= 5 AND count(DISTINCT company_id) >= 5 AND count(*) < (SELECT count(*) FROM ch)"),
    "lattice_pairs": (lattice_pairs, f"{_INC} SELECT an.atom AS anchor, st.atom AS structural, count(*) AS n_chains, count(DISTINCT company_id) AS n_companies FROM an JOIN st USING (company_id, chain_sequence) WHERE NOT (an.atom LIKE 'present%' AND st.atom = 'middle_gte_1') GROUP BY ALL"),
    "lattice_catalog": (lattice_catalog, _CATALOG_SQL),
    "lattice_witnessed_triples": (lattice_witnessed_triples, f"""{_CX} SELECT x.family || ':' || x.event_type || '>' || y.family || ':' || y.event_type || '>' || z.family || ':' || z.event_type AS tuple, count(DISTINCT (x.company_id, x.chain_sequence)) AS n_chains
      FROM mid x JOIN mid y USING (company_id, chain_sequence) JOIN mid z USING (company_id, chain_sequence) WHERE x.hi < y.lo AND y.hi < z.lo GROUP BY ALL"""),
    "mask_representatives": (mask_representatives, f"""{_INC}, {_NUMBERS}, {_BYTES("co", "c")}, p(atom, priority, canonical) AS (VALUES {_PRIORITY})
      SELECT arg_min(atom, (priority, canonical)) AS atom, sha AS mask, count(*) AS n_members FROM co JOIN p USING (atom) GROUP BY sha"""),
    "lattice_masks": (lattice_masks, f"""{_INC}, {_NUMBERS}, {_BYTES("cm", "i")}, {_BYTES("co", "c")}
      SELECT atom, cm.sha AS chain_mask_sha256, cm.n AS n_chains, co.sha AS company_mask_sha256, co.n AS n_companies FROM cm JOIN co USING (atom)"""),
    "lattice_compositions": (lattice_compositions, _COMPOSITIONS_SQL),
    "freeze_evaluation": (freeze_evaluation, f"""{_FROZEN_SQL}, {_COMPANIES}, e AS (SELECT pair, count(*) FILTER (label = 'SUCCESS') AS success_taking, count(*) FILTER (label = 'FAILURE') AS failure_taking FROM (SELECT DISTINCT pair, company_id FROM pr JOIN pc USING (pair)) LEFT JOIN co USING (company_id) GROUP BY pair),
      t AS (SELECT pair AS pattern, success_taking, failure_taking, (SELECT count(*) FROM co WHERE label = 'SUCCESS') - success_taking AS success_not_taking, (SELECT count(*) FROM co WHERE label = 'FAILURE') - failure_taking AS failure_not_taking FROM e), o AS ({_VALUES.replace("v AS (", "WITH v AS (", 1)})
      SELECT anchor, structural, 'ACTION_ELIGIBLE' AS track, n_chains, n_companies, o.* EXCLUDE (pattern) FROM o JOIN pr ON pr.pair = o.pattern"""),
    "freeze_coverage": (freeze_coverage, f"""{_FROZEN_SQL}, {_REFERENCE_SQL},
      k AS (SELECT name, string_agg(company_id::VARCHAR, ',' ORDER BY company_id) AS m FROM (SELECT DISTINCT pair AS name, company_id FROM pr JOIN pc USING (pair) UNION SELECT DISTINCT atom, company_id FROM sa JOIN fa USING (atom)) GROUP BY name),
      r AS (SELECT reference, count(*) AS n_companies, string_agg(company_id::VARCHAR, ',' ORDER BY company_id) AS m FROM (SELECT DISTINCT reference, company_id FROM rf) GROUP BY reference)
      SELECT reference, any_value(n_companies) AS n_companies, min(name) AS covered_by, min(name) IS NOT NULL AS covered FROM r LEFT JOIN k USING (m) GROUP BY reference"""),
    "sequence_matches": (sequence_matches, f"""{_CX}, mp AS (SELECT *, CASE event_id::BIGINT % 3 WHEN 0 THEN 'i' || event_id::BIGINT % 5 WHEN 1 THEN 'n' || event_id::BIGINT % 4 END AS person FROM mid)
      SELECT 'short_steps' AS rule, company_id, chain_sequence FROM ch WHERE {_RULE_SQL["view_click_error"]}
      UNION ALL SELECT DISTINCT 'one_person', x.company_id, x.chain_sequence FROM mp x JOIN mp y USING (company_id, chain_sequence, person) JOIN mp z USING (company_id, chain_sequence, person) WHERE x.event_type = 'view' AND y.event_type = 'view' AND z.event_type = 'view' AND x.hi < y.lo AND y.hi < z.lo
      UNION ALL SELECT DISTINCT 'quick', x.company_id, x.chain_sequence FROM mid x JOIN mid y USING (company_id, chain_sequence) WHERE x.event_type = 'click' AND y.event_type = 'view' AND x.hi < y.lo AND y.hi - x.lo <= 2"""),
    "policy_review": (policy_review, """WITH r AS (SELECT *, l_suppkey % 97 = 0 AS gone FROM lineitem CROSS JOIN (VALUES ('all'), ('any')) AS ops(op))
      SELECT l_orderkey, l_linenumber, op, CASE WHEN gone THEN 'not_human_readable' WHEN l_partkey % 7 = 0 THEN 'exit_event' WHEN l_partkey % 7 = 1 THEN 'event_type_other' WHEN l_linenumber = 5 AND l_linestatus = 'O' THEN 'outcome_type'
        WHEN l_linenumber = 2 AND l_returnflag IN ('A', 'R') THEN 'round_unknown_or_other' WHEN l_linenumber = 3 AND l_linestatus = 'O' THEN 'end_relative_timing' WHEN l_discount = 0.10 OR l_linenumber = 4 AND l_returnflag = 'A' THEN 'duration'
        WHEN l_discount = 0.01 OR l_linenumber = 4 AND l_returnflag = 'N' THEN 'future_only' WHEN l_linenumber = 6 AND l_returnflag IN ('A', 'N') THEN 'nullness_test' WHEN l_linenumber = 4 THEN 'data_quality_basis_or_known_date'
        WHEN l_tax = 0.08 OR l_suppkey % 89 = 0 THEN 'not_human_readable' END AS reason,
        CASE WHEN NOT gone THEN 4 + CASE l_linenumber WHEN 3 THEN 5 WHEN 6 THEN CASE WHEN l_returnflag IN ('A', 'N') THEN 2 ELSE 3 END WHEN 7 THEN 0 ELSE 3 END END AS complexity FROM r"""),
    "lattice_evaluation": (lattice_evaluation, f"""{_INC}, {_COMPANIES}, e AS (SELECT atom AS pattern, count(*) FILTER (label = 'SUCCESS') AS success_taking, count(*) FILTER (label = 'FAILURE') AS failure_taking FROM (SELECT DISTINCT atom, company_id FROM an) JOIN co USING (company_id) WHERE label <> 'AMBIGUOUS' GROUP BY atom),
      t AS (SELECT *, (SELECT count(*) FROM co WHERE label = 'SUCCESS') - success_taking AS success_not_taking, (SELECT count(*) FROM co WHERE label = 'FAILURE') - failure_taking AS failure_not_taking FROM e), {_VALUES}"""),
    "mask_equality": (mask_equality, f"""{_INC}, v AS (SELECT company_id, chain_sequence FROM an WHERE atom = 'present_view'), c AS (SELECT company_id, chain_sequence FROM an WHERE atom = 'present_click')
      SELECT 'differ' AS atom, 'left' AS side, count(*) AS n FROM (SELECT * FROM v EXCEPT SELECT * FROM c) HAVING count(*) > 0 UNION ALL SELECT 'differ', 'right', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM v) HAVING count(*) > 0"""),
    "compatibility": (compatibility, """WITH p AS (SELECT p_partkey AS k, p_partkey AS pair_id, p_partkey % 7 AS f, CASE WHEN p_partkey % 7 = 5 AND p_size % 2 = 0 THEN 'is_null' WHEN (p_partkey // 7) % 2 = 0 THEN 'lte' ELSE 'gte' END AS cmp, p_size % 6 AS v FROM part),
      q AS (SELECT *, CASE f WHEN 0 THEN k % 3 WHEN 1 THEN 0 WHEN 2 THEN k % 4 WHEN 3 THEN k % 2 WHEN 4 THEN k % 5 END AS least, CASE WHEN k % 3 = 0 THEN k % 5 END AS most, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 1 ELSE 0 END AS fam FROM p)
      SELECT pair_id, CASE WHEN f <= 4 AND cmp = 'lte' AND least > v THEN 'UNSAT_COUNT_BOUND' WHEN f <= 4 AND cmp = 'gte' AND least >= v THEN 'ANCHOR_IMPLIES_STRUCTURAL'
        WHEN f <= 2 AND cmp = 'lte' AND (v <= most OR k % 4 = 0 AND v = 0 AND fam IS NOT NULL AND (f = 2 OR f = fam)) THEN 'STRUCTURAL_IMPLIES_ANCHOR' WHEN f = 5 AND cmp = 'is_null' AND k % 2 = 0 THEN 'UNSAT_NULLNESS' END AS reason FROM q"""),
    "review_matrix": (review_matrix, """WITH p AS (SELECT p_partkey AS pattern, CASE WHEN p_size < 10 THEN 'RECOMMEND' WHEN p_size < 30 THEN 'INDIFFERENT' ELSE 'INCONCLUSIVE' END AS result, p_type = 'ECONOMY' AS gone, p_brand || '|' || p_size AS sig, p_partkey % 9 AS c FROM part),
      r AS (SELECT * FROM p WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY sig ORDER BY c, pattern) = 1)
      SELECT result, count(*) AS n, '1_all' AS step FROM p GROUP BY result UNION ALL SELECT result, count(*), '2_after_policy' FROM p WHERE NOT gone GROUP BY result UNION ALL SELECT result, count(*), '3_representatives' FROM r GROUP BY result"""),
    "pattern_registry": (pattern_registry, "SELECT CASE WHEN p_size > 25 THEN 'RECOMMEND' ELSE 'AVOID' END AS result, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1"),
}
