import copy
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import documents, review
from eventloom.plans import catalog_patterns as cp
from eventloom.plans import rules
from tests.conftest import SF, rows

WORDS = "word " * 60
HEAD = {"verdict": "PASS", "verdict_emoji": "✅", "verdict_text": "ok"}
MARKET = HEAD | {
    "tam": {"value_b": 10, "scope": "s", "source": "x", "range_b": [8, 12.5]},
    "sam": {"subset_descriptor": "d", "pct_of_tam": 0.5},
    "som": {"locked_pct": 0.2, "porter_discount": 0.5, "headroom_b": 2.0},
    "porter_forces": {"rivalry": "high", "substitutes": "low", "new_entrants": "med"},
    "search_metadata": {"timestamp": "t", "source_urls": []},
    "refresh_trigger": {"default_interval": "1y"},
    "reasoning": WORDS,
}
PART = {"verdict": "✓", "evidence": "e"}
MOAT = HEAD | {
    "claimed_moats": [{"moat_type": "Brand", "evidence": "e"}],
    "vrio_breakdown": {"dominant_moat": "Brand", "valuable": PART, "rare": PART, "inimitable": PART | {"verdict": "partial"}, "organized": PART | {"verdict": "✗"}, "score": 2.5},
    "erosion_risks": [],
    "search_metadata": {"timestamp": "t"},
    "reasoning": WORDS,
}
EVALUATION = HEAD | {
    "mu_breakdown": {"m_check": {"verdict": "PASS", "som_headroom_b": 1}, "u_check": {"verdict": "WARN", "vrio_score": 2.5}},
    "aggregate": {"weighted_score": 0.75, "weights_used": {"m": 0.5, "u": 0.5}, "verdict_path": "score_threshold"},
    "dominant_driver": {"dim": "U", "verdict": "WARN", "reason": "r"},
    "decision_rationale": WORDS,
    "metadata": {"timestamp": "t", "framework_version": "v1.5a", "founding_year": 2015, "retrieval_window": ["2012-01-01", "2015-12-31"]},
}


def change(doc, path, value):
    doc = copy.deepcopy(doc)
    *keys, last = path.split(".")
    at = doc
    for k in keys:
        at = at[k]
    if value is ...:
        at.pop(last)
    else:
        at[last] = value
    return doc


CASES = [
    (documents.market_messages, MARKET, [("verdict", "MAYBE", 1), ("verdict_emoji", "🔴", 1), ("tam", 5, 1), ("tam.scope", "", 1), ("tam.range_b", [1], 1), ("sam.pct_of_tam", 1.5, 2), ("sam.pct_of_tam", "x", 1), ("som.porter_discount", 0.3, 2), ("som.headroom_b", 2.05, 0), ("som.headroom_b", 3, 1), ("porter_forces.rivalry", ..., 1), ("search_metadata", ..., 1), ("refresh_trigger", {}, 1), ("reasoning", "short", 1), ("reasoning", " ", 1)]),
    (documents.moat_messages, MOAT, [("claimed_moats", [], 1), ("claimed_moats", [{"moat_type": "Luck", "evidence": ""}], 2), ("vrio_breakdown.score", 3.0, 1), ("vrio_breakdown.score", 5, 2), ("vrio_breakdown.rare", {}, 2), ("dominant_moat_required", 1, 1), ("erosion_risks", {}, 1)]),
    (documents.evaluation_messages, EVALUATION, [("archetype", "x", 1), ("mu_breakdown.h_check", {}, 1), ("aggregate.weights_used", {"m": 0.5}, 1), ("aggregate.weights_used", {"m": 0.5, "u": 0.6}, 1), ("dominant_driver.dim", "H", 1), ("metadata.framework_version", "v1.4", 1), ("metadata.founding_year", 1800, 1), ("metadata.retrieval_window", ["2012"], 1), ("decision_rationale", ..., 1)]),
]


@pytest.mark.parametrize("messages, sound, changes", CASES)
def test_documents(spark, messages, sound, changes):
    texts = [json.dumps(sound), "[1]", "{no"] + [json.dumps(change(sound, p, v)) for p, v, _ in changes]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = dict(rows(df.select("id", messages(F.col("text")))))
    assert found[0] == [] and len(found[1]) == len(found[2]) == 1
    for k, (path, value, n) in enumerate(changes, 3):
        assert len(found[k]) == n, (path, value, found[k])


def test_search_queries(spark):
    df = spark.createDataFrame([(1, "AI", None)], "id int, target_market string, sub_segment string")
    found = documents.search_queries(spark, df, documents.MARKET_QUERIES, "id")
    assert found.count() == 5 and found.filter("unresolved").count() == 3
    assert rows(found.filter("query_no = 0"), "query") == [("AI market size forecast",)]


PAIR = "atom string, track string, rule string, taints array<string>, event_dimension string, anchor_dimension string, structural_dimension string, component_dimension string"


def pair(rule, **more):
    rule = rule if rule is None or isinstance(rule, str) else rules.canonical_json(rules.canonical(rule))
    made = {"atom": "p", "track": "ACTION_ELIGIBLE", "rule": rule, "taints": [], "event_dimension": "e", "anchor_dimension": "e", "structural_dimension": "s", "component_dimension": "s"} | more
    return tuple(made[c.split()[0]] for c in PAIR.split(", "))


REMOVALS = [
    (cp.PATTERNS["view_then_click"], {}, None),
    ({"op": "present", "selector": cp._one("exit")}, {}, "exit_event"),
    (json.dumps({"op": "present", "selector": cp._one(" Exit ")}), {}, "exit_event"),
    ({"op": "present", "selector": cp._one("other")}, {}, "event_type_other"),
    (cp._compare({"field": "chain.outcome_type"}, "eq", "x"), {}, "outcome_type"),
    (cp._compare({"field": "derived.outcome_round_bucket"}, "in", ["seed", "unknown"]), {}, "round_unknown_or_other"),
    (cp._compare({"field": "derived.outcome_round_bucket"}, "eq", "Other"), {}, "round_unknown_or_other"),
    (cp._compare({"field": "derived.outcome_round_bucket"}, "eq", "seed"), {}, None),
    (cp.PATTERNS["late_click"], {}, "end_relative_timing"),
    (cp._compare({"field": "derived.chain_duration_days"}, "gte", 1), {}, "duration"),
    (cp.PATTERNS["many_exposures"], {"structural_dimension": "duration", "component_dimension": "duration"}, "duration"),
    (cp._compare({"field": "derived.company_chain_count"}, "gte", 1), {}, "future_only"),
    (cp.PATTERNS["many_exposures"], {"taints": ["end", "future"]}, "future_only"),
    (cp.PATTERNS["many_exposures"], {"taints": None}, None),
    ({"op": "compare", "left": {"field": "derived.middle_span_min"}, "cmp": "not_null"}, {}, "nullness_test"),
    (cp._compare({"field": "derived.interface_investor_basis"}, "eq", "none"), {}, "data_quality_basis_or_known_date"),
    (cp._sequence("a", "b", same=["event.participant_basis"]), {}, "data_quality_basis_or_known_date"),
    ({"op": "all", "rules": [cp.PATTERNS["late_click"], {"op": "not", "rule": {"op": "any", "rules": [cp.PATTERNS["two_views"], {"op": "absent", "selector": cp._one("exit")}]}}]}, {}, "exit_event"),
    (cp.PATTERNS["many_exposures"], {"anchor_dimension": "x"}, "not_human_readable"),
    (cp.PATTERNS["many_exposures"], {"component_dimension": None}, "not_human_readable"),
    (None, {}, "not_human_readable"),
    ("[1, 2", {}, "not_human_readable"),
    ('["exit"]', {}, "not_human_readable"),
]


def test_removal(spark):
    df = spark.createDataFrame([pair(r, atom=str(k), **more) for k, (r, more, _) in enumerate(REMOVALS)], PAIR)
    found = {r.atom: r for r in review.reviewed(df).collect()}
    assert [found[str(k)].reason for k in range(len(REMOVALS))] == [reason for *_, reason in REMOVALS]
    for k, (rule, _, _) in enumerate(REMOVALS):
        if isinstance(rule, dict):
            assert found[str(k)].complexity == rules.complexity(rules.canonical(rule))
    deep = "[" * 40 + "]" * 40
    with pytest.raises(Exception, match="nested deeper"):
        review.reviewed(spark.createDataFrame([pair(deep)], PAIR)).collect()


def test_each_rule_is_read_once(spark):
    """Thousands of pairs of a few rules: their rows only look facts up, which were found for each different text."""
    texts = [rules.canonical_json(rules.canonical(cp.PATTERNS["late_click"])), rules.canonical_json(rules.canonical(cp.PATTERNS["many_exposures"])), "[1"]
    picked = F.get(F.array(*map(F.lit, texts)), (F.col("id") % 4).cast("int"))
    taints = F.when(F.col("id") % 8 == 1, F.array(F.lit("future")))
    df = spark.range(4000).select("id", picked.alias("rule"), taints.alias("taints"), *[F.lit("x").alias(c) for c in ("event_dimension", "anchor_dimension", "structural_dimension", "component_dimension")])
    found = review.reviewed(df)
    assert "variant_get" not in found._jdf.queryExecution().toString()
    assert rows(found.groupBy("reason").count()) == [("end_relative_timing", 1000), ("future_only", 500), ("not_human_readable", 2000), (None, 500)]


def test_representatives(spark):
    kept = {k: rules.canonical(r) for k, r in cp.PATTERNS.items() if k != "late_click"}
    df = spark.createDataFrame([pair(r, atom=k) for k, r in cp.PATTERNS.items()] + [pair('{"op":"nonsense"}', atom="unsound")], PAIR)
    masks = spark.createDataFrame([(k, "m1" if n % 2 else "m2") for n, k in enumerate([*cp.PATTERNS, "unsound"])], "atom string, mask string")
    made = review.catalog(df)
    assert dict(rows(made, "atom", "reason"))["unsound"] == "not_human_readable"
    for r in review.representatives(made, masks).collect():
        mine = [k for k in kept if dict(rows(masks))[k] == r.mask]
        best = min(mine, key=lambda k: (rules.complexity(kept[k]), len(rules.render(kept[k]).split()), len(rules.render(kept[k])), rules.canonical_json(kept[k]), k))
        assert (r.atom, r.n_members) == (best, len(mine))


def test_features_and_profiles(spark):
    made = cp.pattern_set()
    found = review.features(cp._contexts(spark, SF), made).cache()
    assert found.filter("n_middle > 0 and signature = ''").count() == 0
    assert {r[0] for r in rows(found.select("order_status").distinct())} <= {"exact", "partial_batches", "no_middle"}
    profiles = review.primary_profiles(found, made)
    total = profiles.agg(F.sum(sum((F.col(f"{p}_primary_count") for p in cp.PATTERNS), F.lit(0)))).first()[0]
    assert total == found.filter("primary_seed <> 'UNMATCHED'").count()


def test_bounds_and_aliases(spark):
    assert review.bounded(3, 5, "atoms") == 3
    with pytest.raises(review.ResourceBound):
        review.bounded(6, 5, "atoms")
    companies = spark.createDataFrame([("acme  INC",), ("Other",)], "name string")
    aliases = spark.createDataFrame([("Acme Inc", "Acme")], "alias string, canonical string")
    assert rows(review.apply_aliases(companies, aliases)) == [("Acme",), ("Other",)]


@pytest.mark.parametrize("messages", [documents.market_messages, documents.moat_messages, documents.evaluation_messages])
def test_document_is_parsed_once(spark, messages):
    checked = spark.createDataFrame([("{}",)], "text string").select(messages(F.col("text")).alias("m"))
    assert checked._jdf.queryExecution().analyzed().expressions().mkString().count("text#") == 1


def test_card_is_read_once_by_each_expression(spark):
    from eventloom.operators import checks

    checked = spark.createDataFrame([("",)], "card string").select(checks.card_messages(F.col("card")).alias("m"))
    assert checked._jdf.queryExecution().analyzed().expressions().mkString().count("card#") == 8
