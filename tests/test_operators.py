import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import behavior, chains, checks, edges, entities, evaluation, generators, identity, lattice, leakage, storage
from eventloom.plans import rules as rule_language
from tests.conftest import rows

D = dt.date


def outcomes_of(spark, *days):
    data = [("co", "funding_round", None, d) for d in days]
    return spark.createDataFrame(data, "company_id string, event_type string, round_name string, announce_date string")


def test_windows(spark):
    made = chains.sequence_outcomes(outcomes_of(spark, "2020-01-10", "2020-02-10", None))
    assert rows(made, "chain_sequence", "start", "end") == [(1, None, D(2020, 1, 10)), (2, D(2020, 1, 10), D(2020, 2, 10)), (3, D(2020, 2, 10), None)]
    days = ["2019-01-01", "2020-01-10", "2020-02-09", "2020-02-10", None]
    events = spark.createDataFrame([("co", d and D.fromisoformat(d), str(k)) for k, d in enumerate(days)], "company_id string, day date, event_id string")
    # Everything before the first outcome is in chain 1; an event on an outcome's day is in the chain after it; the last day has none.
    assert rows(chains.assign_events(made, events), "event_id", "chain_sequence") == [("0", 1), ("1", 2), ("2", 2)]


def test_outcomes_of_one_day_share_no_events(spark):
    data = [("co", "a", None, "2020-01-10"), ("co", "b", None, "2020-01-10"), ("co", "a", None, "2020-01-20")]
    made = chains.sequence_outcomes(spark.createDataFrame(data, "company_id string, event_type string, round_name string, announce_date string"))
    events = spark.createDataFrame([("co", D(2020, 1, 5), "x"), ("co", D(2020, 1, 10), "y")], "company_id string, day date, event_id string")
    assert rows(chains.assign_events(made, events), "event_id", "chain_sequence") == [("x", 1), ("y", 3)]


def test_partial_boundaries_take_the_first_day(spark):
    made = chains.sequence_outcomes(outcomes_of(spark, "2020", "2020-03", "bad"))
    assert rows(made, "end") == [(D(2020, 1, 1),), (D(2020, 3, 1),), (None,)]


def test_batches(spark):
    data = [("k", "2020", "e1"), ("k", "2020-05-01", "e2"), ("k", "2021-01-01", "e3")]
    df = chains.with_interval(spark.createDataFrame(data, "key string, event_date string, event_id string")).withColumns({"family": F.lit("x"), "event_type": F.lit("t")})
    made = chains.batches(df, "key")
    assert rows(made, "event_id", "batch") == [("e1", 1), ("e2", 1), ("e3", 2)]
    assert rows(chains.batch_gaps(made, "key"), "n_ordered_batches", "min_interbatch_gap_min", "max_interbatch_gap_max") == [(2, 1, 366)]


def test_claims(spark):
    data = [("e", 0, 0.5, "x", 1), ("e", 1, 0.9, "y", 2), ("e", 2, 0.9, "z", 2), ("f", 3, None, "x", None)]
    df = spark.createDataFrame(data, "event_id string, ord long, confidence double, source string, amount long")
    found = {r.event_id: r for r in chains.resolve_claims(df, "ord", ["amount", "source"]).collect()}
    assert (found["e"].ord, found["e"].confidence_tied, found["e"].n_claims, found["e"].conflict_fields) == (1, True, 3, ["amount", "source"])
    assert (found["f"].ord, found["f"].confidence_tied, found["f"].conflict_fields) == (3, False, [])


def test_participants(spark):
    data = [(1, "funding_round", " L ", ["A", "", None], None), (2, "acquired", "L", None, "B"), (3, "funding_withdrawn", None, None, "B"), (4, "acquired", "L", ["A"], None), (5, "ipo", "L", ["A"], "B")]
    df = spark.createDataFrame(data, "id int, event_type string, lead_investor string, co_investors array<string>, acquirer string")
    assert rows(chains.participants(df), "id", "investor_name", "role") == [(1, " L ", "lead"), (1, "A", "co"), (2, "B", "acquirer"), (3, None, "unknown"), (4, None, "acquirer"), (5, None, "unknown")]


def test_event_rows(spark):
    schema = "event_type string, event_date string, amount_usd string, confidence string, round_name string"
    df = spark.createDataFrame([(None, "2020", "5", None, " A  b "), ("acquired", "2020-13", "x", "0.5", "A"), ("rumour", None, None, "high", None)], schema)
    loose = rows(chains.event_rows(df, ("funding_round", "acquired"), strict=False, default_type="funding_round"))
    assert loose == [("acquired", None, None, 0.5, None), ("funding_round", "2020", 5, 0.0, "A b"), ("other", None, None, 0.0, None)]
    with pytest.raises(Exception, match="unknown event type: rumour"):
        chains.event_rows(df, ("funding_round", "acquired"), strict=True, default_type="funding_round").collect()


def test_group_outcomes(spark):
    data = [("e1", "c", "t", None, None, "i2", "B", 2), ("e1", "c", "t", None, None, "i1", "A", 1), ("e2", "c", "t", None, None, "i2", None, 3), ("e3", "c", "t", "r", None, None, None, 4)]
    df = spark.createDataFrame(data, "event_id string, company_id string, event_type string, round_name string, announce_date string, investor_id string, raw_investor_name string, ord int")
    found = {r.round_name: r for r in chains.group_outcomes(df).collect()}
    assert (found[None].n_participant_rows, found[None].outcome_event_ids, found[None].investor_ids, found[None].investor_raw_names) == (3, ["e1", "e2"], ["i1", "i2"], ["A", "B"])
    assert (found["r"].outcome_event_ids, found["r"].investor_ids) == (["e3"], [])


def test_history_of_a_hot_company_reads_each_investor_once(spark):
    """Chains of one company that all share an investor: the plan gathers no running list, and the counts are right."""
    df = spark.range(3000).select(F.lit(1).alias("company_id"), "id", F.concat(F.lit("c"), "id").alias("chain_id"), F.lit("seed").alias("round_name"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("end"), F.array(F.lit("hot"), F.concat(F.lit("i"), F.col("id") % 1000), F.lit(None)).alias("investor_keys"))
    found = chains.history(df.withColumnRenamed("id", "chain_sequence"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.chain_sequence: r.prior_outcome_investor_overlap_count for r in found.collect()}
    assert len(counts) == 3000 and all(n == (0 if k == 0 else 2 if k < 1000 else 3) for k, n in counts.items())


def test_history_takes_a_chain_back_whole(spark):
    """Only one row of a chain carries its columns while its investors are looked up; a chain without investors doesn't make an unnamed one known."""
    keys = [[], None, [None], [None, "a", "a"], ["a", "b"], []]
    df = spark.createDataFrame([("co", k, f"c{k}", "seed", D(2020, 1, k + 1), v) for k, v in enumerate(keys)], "company_id string, chain_sequence int, chain_id string, round_name string, end date, investor_keys array<string>")
    found = chains.history(df)
    assert rows(found, "chain_sequence", "prior_outcome_investor_overlap_count", "prior_outcome_investor_overlap_ratio") == [(0, 0, None), (1, None, None), (2, 0, 0.0), (3, 1, 0.5), (4, 1, 0.5), (5, 0, None)]
    assert dict(rows(found, "chain_sequence", "investor_keys")) == dict(enumerate(keys))


def test_signatures_agree(spark):
    data = [("k", 1, "exposure", "view", "a"), ("k", 1, "interface", "exit", "b"), ("k", 2, "exposure", "view", "c"), ("k", 1, "exposure", "click", "d"), ("l", 1, "exposure", "x", "e")]
    df = spark.createDataFrame(data, "k string, batch long, family string, event_type string, event_id string")
    found = dict(rows(chains.signatures(df, "k"), "k", "signature"))
    assert found == {"k": "{E:click|E:view|I:exit}>{E:view}", "l": "{E:x}"}
    packed = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("batch", "family", "event_type", "event_id"))).alias("events"))
    assert dict(rows(packed.select("k", chains.signature(F.col("events"))))) == found


def test_threshold_steps_of_a_hot_investor(spark):
    """Very large numbers give a few steps, not their product; counts are those of the brute force."""
    data = [(1, 1_000_000, 5), (2, 3, 2_000_000), (3, 3, 4), (4, 0, 9), (5, 2, 4)]
    df = spark.createDataFrame(data, "i int, n_core_episode_count long, n_all_interface_companies long")
    found = behavior.threshold_steps(df).collect()
    assert len(found) == 8
    for r in found:
        for e in (r.low_e, r.e):
            for c in (r.low_c, r.c):
                assert r.investor_count == sum(x >= e and y >= c for _, x, y in data)
    small = spark.createDataFrame([(1, 3, 2), (2, 1, 4), (3, 3, 2)], "i int, n_core_episode_count long, n_all_interface_companies long")
    want = [(e, c, n) for e in range(1, 4) for c in range(1, 5) if (n := sum(x >= e and y >= c for x, y in ((3, 2), (1, 4), (3, 2))))]
    assert rows(behavior.threshold_grid(small)) == sorted(want, key=lambda r: tuple((False, str(x)) for x in r))


def test_witnessed_tuples(spark):
    import itertools
    import random

    rnd = random.Random(3)
    data = [(c, "exposure", rnd.choice("abc"), d, d + rnd.randint(0, 3)) for c in range(30) for d in rnd.sample(range(20), 5)]
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), F.col(n))
    df = spark.createDataFrame(data, "chain_id int, family string, event_type string, a int, b int").withColumns({"lo": day("a"), "hi": day("b")})
    for length in (2, 3):
        want = {}
        for c in range(30):
            mine = [x for x in data if x[0] == c]
            for t in {tuple(f"exposure:{x[2]}" for x in chosen) for chosen in itertools.permutations(mine, length) if all(x[4] < y[3] for x, y in zip(chosen, chosen[1:]))}:
                want[t] = want.get(t, 0) + 1
        assert {tuple(r.tuple): r.n_chains for r in generators.witnessed(df, length).collect()} == want


def test_generated_atoms_are_valid_rules(spark):
    from eventloom.plans import catalog_patterns as cp

    contexts = cp._contexts(spark, "/root/testdata/sf0.001")
    types = generators.observed_types(contexts)
    assert types == sorted(cp.TYPES)
    atoms = generators.anchors(contexts, types) + generators.structural(contexts) + generators.sequences([["interface:signup", "interface:signup"], ["exposure:view", "interface:signup"]])
    for x in atoms:
        rule_language.check_rule(x.rule)
    assert len({x.name for x in atoms}) == len({x.id for x in atoms}) == len(atoms)
    assert {x.kind for x in atoms} == {*generators.KINDS, "sequence", "structural"}
    assert {x.dimension for x in atoms if x.kind == "structural"} >= {"round", "duration", "count", "cadence", "share", "density", "history"}
    timing = [x for x in atoms if x.kind == "timing"]
    assert timing and all(x.facts["needs_start"] == ("start" in x.name) and ("end" in x.taints) == (" end " in x.name) for x in timing)
    same = [x for x in atoms if x.rule.get("same_values")]
    assert same and all(x.facts["participant_min"] == 1 and x.facts["count_min"] == {"total": 2, "interface": 2} for x in same)
    few = [x for k, x in enumerate(atoms) if k % 12 == 0]
    held = lattice.incidence(contexts, {x.name: x.rule for x in few})
    assert held.select("atom").distinct().count() > len(few) / 4


def test_freeze_and_evaluate(spark, tmp_path):
    from eventloom.operators import freeze
    from eventloom.plans import catalog_patterns as cp

    contexts = storage.written(cp._contexts(spark, "/root/testdata/sf0.001"))
    types = generators.observed_types(contexts)
    anchors = generators.anchors(contexts, types, ("present", "absent", "count"))
    structural = generators.structural(contexts, ("derived.n_middle", "derived.company_chain_count"), rounds=False)
    inputs = {"events": spark.read.parquet("/root/testdata/sf0.001/events.parquet")}
    where = f"{tmp_path}/frozen"
    with pytest.raises(ValueError, match="must not be seen"):
        freeze.freeze(contexts, anchors, structural, {"x": inputs["events"].withColumn("label", F.lit(1))}, where, "label")
    freeze.freeze(contexts, anchors, structural, inputs, where, "label")
    tables = freeze.load(spark, where, inputs)
    with pytest.raises(ValueError):
        freeze.load(spark, where, {"events": inputs["events"].limit(5)})
    pairs, atoms = tables["pairs"].collect(), {r.atom: r for r in tables["atoms"].collect()}
    assert pairs and all(r.n_chains >= 5 and r.n_companies >= 5 for r in pairs)
    assert {r.track for r in pairs} == {freeze.ELIGIBLE, freeze.DESCRIPTIVE}
    assert all((r.track == freeze.DESCRIPTIVE) == bool(atoms[r.anchor].taints or atoms[r.structural].taints) for r in pairs)
    assert not any(r.anchor.endswith("present") and r.structural == "derived.n_middle gte 1" for r in pairs)
    # Support and tables again, from the rules themselves.
    chains_ = contexts.select(F.col("chain.company_id").alias("c"), *[rule_language.compile_rule(rule_language.parse(a.rule)).alias(n) for n, a in atoms.items()]).collect()
    labels = {r.c: ("SUCCESS", "FAILURE")[k % 2] for k, r in enumerate(sorted(chains_, key=lambda r: r.c))}
    values = {r.atom: r for r in freeze.evaluate(tables, contexts, spark.createDataFrame(list(labels.items()), "company_id long, label string")).collect()}
    assert len(values) == len(pairs)
    for r in pairs[:: max(1, len(pairs) // 40)]:
        held = [x.c for x in chains_ if x[r.anchor] and x[r.structural]]
        assert (len(held), len(set(held))) == (r.n_chains, r.n_companies)
        assert values[r.atom].success_taking == sum(labels[c] == "SUCCESS" for c in set(held))
    found = {r.reference: r for r in freeze.coverage(tables, contexts, {"known": anchors[0].rule, "none": {"op": "all", "rules": [anchors[0].rule, {"op": "compare", "left": {"field": "derived.n_middle"}, "cmp": "eq", "right": {"literal": 2}}]}}).collect()}
    assert found["known"].covered or anchors[0].name not in atoms


def test_materializable():
    view, click = ({"op": "present", "selector": lattice.selector("exposure", t)} for t in ("view", "click"))
    known = {rule_language.rule_id("A_", r) for r in (view, click)}
    either = {"op": "any", "rules": [view, click]}
    assert rule_language.materializable({"op": "all", "rules": [view, either]}, known, "A_") == sorted(known)
    for wrong in ({"op": "all", "rules": [view]}, {"op": "all", "rules": [either, either]}, {"op": "any", "rules": [view, either]}, {"op": "all", "rules": [view, {"op": "all", "rules": [view, click]}]}, {"op": "any", "rules": [view, click, view, click]}, {"op": "absent", "selector": view["selector"]}):
        with pytest.raises(rule_language.RuleError):
            rule_language.materializable(wrong, known, "A_")


def test_events_of_a_hot_company_are_dealt_by_month(spark):
    """Against the definition, with events far from any outcome."""
    import random

    rnd = random.Random(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    ends = sorted(rnd.sample(range(1500), 12))
    made = spark.createDataFrame([(1, k + 1, day(e)) for k, e in enumerate(ends)] + [(1, 99, day(ends[3])), (1, 100, None)], "company_id int, chain_sequence long, end date")
    events = [(1, day(rnd.randint(-400, 1600)), f"e{k}") for k in range(500)] + [(1, None, "undated"), (2, day(5), "stranger")]
    df = spark.createDataFrame(events, "company_id int, day date, event_id string")
    found = chains.assign_events(made, df)
    want = {i: next((k + 1 for k, e in enumerate(ends) if day(e) > d), None) for c, d, i in events if d and c == 1}
    assert dict(rows(found, "event_id", "chain_sequence")) == {i: k for i, k in want.items() if k}
    assert found.columns == ["company_id", "day", "event_id", "chain_sequence"]
    assert chains.assign_events(made, df.limit(0)).count() == 0


def test_small_checks(spark):
    from eventloom.functions import names as n, stats
    from eventloom.operators import context

    df = spark.createDataFrame([(1, "v1", "✓", "partial", 1.5), (2, "v1", "✗", "✓", 2.0), (3, None, "✓", "✓", 2.0)], "id int, schema_version string, a string, b string, s double")
    assert checks.require_columns(df, ["id"], "t") is df
    with pytest.raises(ValueError, match="t lacks x, y"):
        checks.require_columns(df, ["id", "x", "y"], "t")
    assert rows(checks.single_version(df)) == [(1, True)]
    assert [r[0] for r in df.orderBy("id").select(F.size(checks.mark_sum_messages([F.col("a"), F.col("b")], F.col("s")))).collect()] == [0, 1, 0]
    assert [round(r[0], 6) for r in spark.createDataFrame([(0.0,), (1.96,)], "z double").select(stats.normal_cdf("z")).collect()] == [0.5, 0.975002]
    sizes = spark.createDataFrame([(100.0, 0.5, 0.2, 0.5, 20.5), (100.0, 0.5, 0.2, 0.5, 30.0)], "t double, s double, l double, d double, x double")
    assert [r[0] for r in sizes.select(stats.headroom_ok(*map(F.col, "tsldx"))).collect()] == [True, False]
    texts = spark.createDataFrame([(None,), (" ",), ("x",)], "t string")
    assert [r[0] for r in texts.select(n.to_list(F.col("t"))).collect()] == [[], [], ["x"]]
    assert [r[0] for r in spark.createDataFrame([(None,), (["a"],)], "t array<string>").select(n.to_list(F.col("t"), True)).collect()] == [[], ["a"]]
    assert [r[0] for r in spark.createDataFrame([(None,), (float("nan"),), (1.5,)], "v double").select(n.nullable_text(F.col("v"))).collect()] == [None, None, "1.5"]
    assert [r[0] for r in spark.createDataFrame([("good",), ("bad",), ("x",)], "t string").select(n.canonical_label(F.col("t"), "good", "bad")).collect()] == ["SUCCESS", "FAILURE", None]
    assert [r[0] for r in spark.createDataFrame([("\tSeed\u00a0",), ("Series  A",)], "t string").select(n.normalize_stage(F.col("t"))).collect()] == ["seed", None]
    mapped = identity.remap(spark.createDataFrame([("L1", "f"), ("L2", "g")], "investor_id string, field string"), spark.createDataFrame([("L1", "b1"), ("L2", None)], "legacy_id string, investor_id string"))
    assert rows(mapped, "investor_id", "field") == [("b1", "f")]
    shaped = identity.entity_rows(spark.createDataFrame([(1, dt.date(2020, 1, 2))], "id int, first_seen_at date"), {"id": "string", "first_seen_at": "string", "name": "string"})
    assert rows(shaped) == [("1", "2020-01-02", None)]
    spans = spark.createDataFrame([([("a", dt.date(2020, 1, 1), dt.date(2020, 12, 31), "year"), ("b", dt.date(2020, 6, 1), dt.date(2020, 6, 1), "day")], dt.date(2020, 3, 1), dt.date(2021, 1, 1))], "events array<struct<event_id:string,lo:date,hi:date,date_precision:string>>, s date, e date")
    assert spans.select(context.straddling(F.col("events"), F.col("s"), F.col("e"))).first()[0] == ["a"]


def test_build_companies(spark):
    data = [(1, "Acme, Inc.", "acme inc", '{"cusip": "1"}'), (2, "ACME Corp", "acme corp", None), (3, "Read More", "read more", None), (4, "Straße  GmbH", "strasse gmbh", None), (5, "x", "x", None), (6, None, None, None), (7, "Zeta", "zeta", '{"cusip": "7"}')]
    edges_ = spark.createDataFrame(data, "row long, company_name_raw string, company_normalized_name string, metadata_json string")
    listed = spark.createDataFrame([("STRASSE GMBH", "Acme")], "alias string, canonical string")
    found = rows(entities.build_companies(edges_, listed), "key", "company_canonical_name", "company_normalized_name", "cusip", "edge_count", "company_id")
    assert found == [("acme", "Acme, Inc.", "acme inc", "1", 3, "co:0000-0001:acme"), ("zeta", "Zeta", "zeta", "7", 1, "co:0000-0002:zeta")]
    assert rows(entities.build_companies(edges_.drop("metadata_json")), "key", "cusip") == [("acme", None), ("strasse gmbh", None), ("zeta", None)]


def test_match_investors_by_slug_then_name(spark):
    events = spark.createDataFrame([("Acme Capital",), ("Beta",), ("None such",), ("École du Nord",), (None,), ("",)], "investor_name string")
    investors = spark.createDataFrame([("i1", "acme", 0), ("i2", "beta", 1), ("i3", "beta", 2), ("i4", "ecole-du-nord", 3)], "investor_id string, slug string, row int")
    assert rows(chains.match_investors(events, investors), "investor_name", "investor_id") == [("", None), ("Acme Capital", "i1"), ("Beta", "i3"), ("None such", None), ("École du Nord", "i4"), (None, None)]


@pytest.mark.parametrize(
    "evidence, event, status",
    [
        (["2019"], "2020-03", behavior.CONFIRMED),
        (["2020"], "2020-03", behavior.OVERLAPPING),
        (["2021"], "2020-03", behavior.AFTER),
        (["2021", None], "2020-03", behavior.UNKNOWN),
        ([None], "2020-03", behavior.UNKNOWN),
        (["2019"], "bad", behavior.UNKNOWN),
        ([], "2020-03", behavior.NONE),
    ],
)
def test_temporal_relation(spark, evidence, event, status):
    funding = spark.createDataFrame([("i", "c", e) for e in evidence] + [(None, "c", "2000")], "investor_id string, company_id string, announce_date string")
    interface = spark.createDataFrame([], "investor_id string, company_id string, event_type string, event_date string")
    events = spark.createDataFrame([("i", "c", event)], "investor_id string, company_id string, event_date string")
    found = behavior.relate(events, behavior.pair_bounds(behavior.evidence(funding, interface)))
    assert rows(found, "temporal_relation_status") == [(status,)]


def test_entities(spark):
    columns = "row long, source string, wikidata_qid string, domain string, normalized_name string, location_state array<string>, findfunding_slug string, manual_seed_slug string"
    data = [
        (1, "seed", "Q1", "linkedin.com", "a", None, None, None),
        (2, "wikidata", "Q1", "x.com.co", "b", None, None, None),
        (3, "seed", None, "x.com.co", "c", ["CA"], None, None),
        (4, "seed", None, "linkedin.com", "d", ["NY"], None, None),
        (5, "seed", None, None, "c", ["NY", "CA"], None, None),
        (6, "url_verify", None, "x.com.co", "z", None, None, None),
    ]
    found = dict(rows(entities.components(entities.entity_keys(spark.createDataFrame(data, columns)))))
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}  # a shared aggregator domain, or a verified URL, merges nothing


def test_fusion_prefers_confidence_then_source_then_row(spark):
    data = [(1, 1, "a", 2, 0.5, ["x"], None), (1, 2, "b", 1, 0.9, ["y", "x"], 1990), (1, 3, "c", 2, 0.9, None, 1991), (1, 4, "d", 0, 0.1, [], 1992)]
    df = spark.createDataFrame(data, "component long, row long, source string, priority int, confidence double, tags array<string>, year int")
    assert rows(entities.fuse(df, ["tags"], ["year"]), "source_set", "tags", "year") == [(["a", "b", "c", "d"], ["x", "y"], 1990)]


def test_edges(spark):
    columns = "investor_id string, company_normalized_name string, company_name_raw string, row int, stage_at_investment array<string>, industry array<string>, company_url string, position string"
    data = [("i", "a", "Read More", 0, ["seed"], None, None, "active"), ("i", "a", "A", 1, ["seed", "growth"], ["x"], "u", "exited"), ("i", "b", "/b", 2, None, None, None, None)]
    df = spark.createDataFrame(data, columns)
    assert rows(edges.upsert(df), "company_normalized_name", "stage_at_investment", "company_url", "position") == [("a", ["seed", "growth"], "u", "active"), ("b", [], None, None)]
    assert rows(edges.coverage(df), "n_edges", "n_companies", "n_company_url", "n_industry") == [(3, 2, 1, 1)]
    assert rows(edges.spot_check(df), "boilerplate_names", "url_names", "no_url") == [(True, False, False)]


def test_identity(spark):
    events = spark.createDataFrame([("1", None, "Acme Fund"), ("2", "i", "x"), ("3", None, " "), ("4", None, "Acme")], "event_id string, investor_id string, raw_investor_name string")
    package = identity.package_rows(events)
    assert rows(package, "raw_investor_name", "event_ids") == [("Acme", ["4"]), ("Acme Fund", ["1"])]
    given = spark.createDataFrame([("1", "i9", None, "NEW_INVESTOR"), ("5", None, "ae", "ASSOCIATED_ENTITY")], "event_id string, investor_id string, associated_entity_id string, status string")
    more = events.unionByName(spark.createDataFrame([("5", "i", "y")], events.schema))
    found = identity.apply_resolutions(more, given)
    # A resolution decides in full; without one an event is of an existing investor or unresolved.
    assert rows(found, "event_id", "investor_id", "associated_entity_id", "counterparty_resolution_status") == [("1", "i9", None, "NEW_INVESTOR"), ("2", "i", None, "EXISTING_INVESTOR"), ("3", None, None, "UNRESOLVED"), ("4", None, None, "UNRESOLVED"), ("5", None, "ae", "ASSOCIATED_ENTITY")]
    assert rows(identity.coverage_gaps(events, given, "event_id").filter("gap = 'missing'"), "event_id") == [("2",), ("3",), ("4",)]


def test_collisions_and_conflicts(spark):
    base = spark.createDataFrame([("b1", "Q1", "Acme, Inc"), ("b2", "Q1", "Acme Inc")], "investor_id string, wikidata_qid string, name string")
    added = spark.createDataFrame([("n1", "Q1", "One"), ("n2", None, "ACME INC."), ("n3", "Q9", "Two"), ("n4", "Q9", "Three"), ("b1", None, None), ("n5", "Q7", "Five")], "investor_id string, wikidata_qid string, name string")
    assert rows(identity.appended_collisions(base, added)) == [("b1", "investor_id", "b1"), ("n1", "wikidata_qid", "Q1"), ("n2", "name", "acme inc"), ("n3", "wikidata_qid", "Q9"), ("n4", "wikidata_qid", "Q9")]
    assert rows(identity.conflicting_keys(base, "wikidata_qid", "investor_id")) == [("Q1", 2)]


def test_quote(spark):
    df = spark.createDataFrame([("abcdef", "cd", 2, 4), ("abcdef", "cd", 1, 3), (None, "cd", 2, 4)], "s string, q string, a int, b int")
    assert [r[0] for r in df.select(identity.quote_holds(*map(F.col, "sqab"))).collect()] == [True, False, False]


def test_chain_violations(spark):
    chain = {"chain_id": "x", "company_id": "c", "company_label_v4": "L", "chain_start_date": "founding", "chain_end_date": "2020-01-01", "chain_window_status": "dated", "n_participant_rows": 1, "n_exposure": 1, "n_interface": 0,
             "outcome_event_ids": ["p"], "exposure_event_ids": ["e"], "exposure_types": ["t"], "interface_event_ids": [], "interface_types": []}
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in chain.items())
    events = spark.createDataFrame([("e", "exposure", "c", "t"), ("o", "exposure", "other", "t"), ("i", "interface", "c", "u")], "event_id string, family string, company_id string, event_type string")
    companies = [("c", "L"), ("other", "L")]

    def check(*cs, companies=companies):
        made = spark.createDataFrame([tuple(c.values()) for c in cs], schema)
        return {v for _, v in rows(checks.chain_violations(made, events, spark.createDataFrame(companies, "company_id string, label string")))}

    assert check(chain) == set()
    assert check(chain, chain) == {"repeated chain"}
    assert check(chain, companies=companies + [("c", "L")]) == {"repeated company"}
    assert check(chain, companies=companies[:1]) == {"event of an unknown company"}
    assert check(chain | {"company_id": "z"}) == {"unknown company", "event of another company"}
    assert check(chain | {"company_label_v4": None}) == {"label differs"}
    assert check(chain | {"chain_window_status": "open"}) == {"unknown window status"}
    assert check(chain | {"chain_start_date": "2020"}) == {"start isn't a day"}
    assert check(chain | {"n_exposure": 2, "chain_end_date": "2020"}) == {"counts differ", "end isn't a day"}
    assert check(chain | {"exposure_types": ["t", "t"]}) == {"counts differ", "missing event"}
    assert check(chain | {"outcome_event_ids": None}) == {"participants differ"}
    assert check(chain | {"exposure_event_ids": ["none"]}) == {"missing event"}
    assert check(chain | {"exposure_event_ids": ["i"], "exposure_types": ["u"]}) == {"event of another family"}
    assert check(chain | {"exposure_types": ["u"]}) == {"event of another type"}
    assert check(chain | {"n_exposure": 2, "exposure_event_ids": ["e", "e"], "exposure_types": ["t", "t"]}) == {"repeated event"}
    assert check(chain | {"chain_window_status": "unknown_end_date"}) == {"undated chain with events", "undated chain with an end"}


def test_row_digest(spark):
    """Against the bytes put together by struct."""
    import hashlib
    import struct

    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e308, 5e-324, 2.2250738585072014e-308, 1e-310, float("inf"), float("-inf"), float("nan"), None, 2.0**53]
    df = spark.createDataFrame([(v, "é" if k % 2 else None) for k, v in enumerate(numbers)], "v double, t string")
    sized = lambda x: struct.pack(">Q", len(x)) + x
    for r in df.select("v", "t", identity.row_sha256("t", "v", doubles=("v",)).alias("h")).collect():
        raw = b"interface-source-row-sha-v1\0"
        for name, kind, value in (("t", "large_string", r.t), ("v", "double", r.v)):
            raw += sized(name.encode()) + sized(kind.encode())
            raw += b"\0" * 9 if value is None else b"\1" + sized(value.encode() if isinstance(value, str) else struct.pack(">d", value))
        assert r.h == hashlib.sha256(raw).hexdigest()


CARD = "**Slug**: x\n**Public/private**: `public`\n**Founding year**: 2015\n**Closest existing vendor analogues**: y\n**Original proposal description**: it was acquired by Big in 2019\n---\n\n" + "\n".join(f"## {k}. {s}\n{'word ' * 60}\n- risk one\n" for k, s in enumerate(checks.CARD_SECTIONS, 1))


def test_cards(spark):
    df = spark.createDataFrame([("ok", CARD), ("year", CARD.replace("2015", "2150")), ("short", CARD.replace("word " * 60, "word ", 1)), ("risk", CARD.replace("- risk one", "")), ("gone", CARD.replace("Cost structure", "Costs"))], "id string, card string")
    found = {r.id: r.m for r in df.select("id", checks.card_messages(F.col("card")).alias("m")).collect()}
    assert found["ok"] == []
    assert found["year"] == ["FAIL: the founding year is out of range"]
    assert found["short"] == ["WARN: section Revenue model is short"]
    assert found["risk"] == ["FAIL: no risk is listed"]
    assert found["gone"] == ["FAIL: section Cost structure is missing"]


@pytest.mark.parametrize("text, pattern, found", [
    ("por sedo\u00f1oes", "domain_broker_name", ["sedo"]), ("\u00e9sedo", "domain_broker_name", ["sedo"]), ("sedoes", "domain_broker_name", None), ("ban\u212arupt", "shutdown_keyword", ["ban\u212arupt"]),
    ("dead\x0blink", "dead_link", None), ("observed\u2028the shutdown", "observed_outcome", ["observed"]), ("observed\nthe shutdown", "observed_outcome", None),
])
def test_leakage_words_are_ascii(spark, text, pattern, found):
    df = spark.createDataFrame([(1, text)], "card_id int, text string")
    got = {r.pattern: r.matches for r in leakage.hits(df, "card_id", "text").collect()}
    assert got.get(pattern) == found


def test_leakage(spark):
    df = spark.createDataFrame([("a", CARD), ("b", "nothing"), ("c", None)], "card_id string, text string")
    found = {r.card_id: r for r in leakage.scan(df).collect()}
    assert (found["a"].founding_year, found["a"].public_private_field, found["a"].post_founding_years, found["a"].severity_score, found["a"].severity) == (2015, "public", [2019], 7, "HIGH")
    assert found["b"].severity == found["c"].severity == "LOW"
    assert rows(leakage.hits(df, "card_id", "text").filter("family = 'acquisition'"), "pattern") == [("acquired_by_upper",), ("was_acquired",)]


def test_quotas_go_to_the_largest_remainders(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 3, "label string")
    assert rows(evaluation.quotas(df, "label", 4), "label", "quota") == [("a", 2), ("b", 1), ("c", 1)]
    assert sum(q for _, q in rows(evaluation.quotas(df, "label", 7), "label", "quota")) == 7


def test_witnessed_pairs_match_brute_force(spark):
    data = [("k", "a", D(2020, 1, 1), D(2020, 1, 5)), ("k", "b", D(2020, 1, 3), D(2020, 1, 9)), ("k", "a", D(2020, 2, 1), D(2020, 2, 2)), ("m", "b", D(2020, 1, 1), D(2020, 1, 1)), ("m", "a", D(2020, 1, 2), D(2020, 1, 2))]
    df = spark.createDataFrame(data, "chain_id string, event_type string, lo date, hi date")
    want = {}
    for k in ("k", "m"):
        mine = [r for r in data if r[0] == k]
        for p in {(x[1], y[1]) for x in mine for y in mine if x[3] < y[2]}:
            want[p] = want.get(p, 0) + 1
    assert {(a, b): n for a, b, n in rows(lattice.witnessed_pairs(df))} == want


def test_atoms():
    found = lattice.presence_atoms([("exposure", "a"), ("exposure", "b"), ("interface", "c")])
    assert len(found) == 8
    assert len(lattice.numeric_atoms("derived.n_middle", "count", 1, 5)) == 8
    assert len(lattice.sequence_atoms([(("exposure", "a"), ("interface", "c"))], gaps=True)) == 17
    assert len({json.dumps(x, sort_keys=True) for x in found}) == 8


def test_support_without_an_expansion_by_type(spark):
    """Two narrow rows an event, whatever the number of types; equal keys of episodes count once across companies and types, as text."""
    rnd = random.Random(3)
    kinds = [*behavior.CORE, "funding_participation", "other", None]
    data = [(rnd.choice(["a", "b", "c", None]), rnd.choice(["N1", "N2", None]), rnd.choice(["x", "y", "x|exit|2020", None]), f"e{rnd.randrange(9)}", rnd.choice(kinds), rnd.choice(["2020", "2021-02", "2020|exit|2020", "", None])) for _ in range(400)]
    df = spark.createDataFrame(data, "investor_id string, investor_name string, company_id string, event_id string, event_type string, event_date string")
    found = behavior.support(df, ranked=False)
    assert "Expand" not in found._jdf.queryExecution().toString()
    text = lambda r: "|".join(x for x in (r[2], r[4], r[5]) if x is not None) if r[5] else f"event|{r[3]}"
    made = {r.investor_id: r for r in found.collect()}
    assert sorted(made) == ["a", "b", "c"]
    for who, r in made.items():
        mine = [x for x in data if x[0] == who]
        core = [x for x in mine if x[4] in behavior.CORE]
        named = {x[2] for x in mine}
        both = sum({"funding_participation", "exit"} <= {x[4] for x in mine if x[2] == c} for c in named)
        assert r.investor_name == min(x[1] for x in mine if x[1])
        assert (r.n_interface_event_rows, r.n_core_event_rows, r.n_exit_event_rows) == (len(mine), len(core), sum(x[4] == "exit" for x in mine))
        assert (r.n_all_interface_companies, r.n_core_companies, r.n_funding_to_exit_companies) == (len(named - {None}), len({x[2] for x in core} - {None}), both)
        assert r.n_funding_participation_rows == sum(x[4] == "funding_participation" for x in mine)
        assert r.n_core_episode_count == len({text(x) for x in core})
        for t in behavior.CORE:
            assert r[f"n_{t}_episode_count"] == len({text(x) for x in core if x[4] == t})


def test_profiles_hash_their_rows(spark):
    """Least and greatest partial dates keep the order of texts, without sorting an investor's rows."""
    dates = ["2021", "2021-01", "2020-12-31", "0001-02", "bad", "2021-13", None, "2021-12", "2021-12-31"]
    data = [(w, c, "SUCCESS", f"e{k}", t, d, behavior.CONFIRMED) for w, c in (("a", "x"), ("b", "y")) for k, (d, t) in enumerate(zip(dates[:: 1 if w == "a" else 4], ["exit", None, "board_change"] * 3))] + [("c", "x", "FAILURE", "e", None, "bad", behavior.NONE)]
    df = spark.createDataFrame(data, "investor_id string, company_id string, company_label string, event_id string, event_type string, event_date string, temporal_relation_status string")
    found = behavior.profiles(df)
    assert rows(found, "investor_id", "n_distinct_event_types", "n_dated_event_rows", "first_interface_event_date", "last_interface_event_date") == [("a", 2, 6, "0001-02", "2021-12-31"), ("b", 2, 2, "2021", "2021-12-31"), ("c", 0, 0, None, None)]
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
