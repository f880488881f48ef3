"""Queries on the checks of documents: invented ones, sound and broken in known ways, one for each order.

The twins say what is wrong with each kind; nothing of the checks is in them.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from eventloom.operators import checks, documents
from eventloom.plans import analogues as a

_WORDS = "word " * 60
_HEAD = {"verdict": "PASS", "verdict_emoji": "✅", "verdict_text": "ok"}
_PART = {"verdict": "✓", "evidence": "e"}
MARKET = _HEAD | {
    "tam": {"value_b": 10, "scope": "s", "source": "x", "range_b": [8, 12.5]},
    "sam": {"subset_descriptor": "d", "pct_of_tam": 0.5},
    "som": {"locked_pct": 0.2, "porter_discount": 0.5, "headroom_b": 2.0},
    "porter_forces": {"rivalry": "high", "substitutes": "low", "new_entrants": "med"},
    "search_metadata": {"timestamp": "t", "source_urls": []},
    "refresh_trigger": {"default_interval": "1y"},
    "reasoning": _WORDS,
}
MOAT = _HEAD | {
    "claimed_moats": [{"moat_type": "Brand", "evidence": "e"}],
    "vrio_breakdown": {"dominant_moat": "Brand", "valuable": _PART, "rare": _PART, "inimitable": _PART | {"verdict": "partial"}, "organized": _PART | {"verdict": "✗"}, "score": 2.5},
    "erosion_risks": [],
    "search_metadata": {"timestamp": "t"},
    "reasoning": _WORDS,
}
EVALUATION = _HEAD | {
    "mu_breakdown": {"m_check": {"verdict": "PASS", "som_headroom_b": 1}, "u_check": {"verdict": "WARN", "vrio_score": 2.5}},
    "aggregate": {"weighted_score": 0.75, "weights_used": {"m": 0.5, "u": 0.5}, "verdict_path": "score_threshold"},
    "dominant_driver": {"dim": "U", "verdict": "WARN", "reason": "r"},
    "decision_rationale": _WORDS,
    "metadata": {"timestamp": "t", "framework_version": "v1.5a", "founding_year": 2015, "retrieval_window": ["2012-01-01", "2015-12-31"]},
}
#: Changes of a sound document (place, value; None: taken away) and what is wrong then.
MARKET_CHANGES = (
    ((), ()),
    (("verdict_emoji", "🔴"), ("FAIL: verdict_emoji doesn't match the verdict",)),
    (("tam.scope", ""), ("FAIL: tam.scope is required",)),
    (("tam.range_b", [1]), ("FAIL: tam.range_b must be a pair of numbers",)),
    (("som.headroom_b", 3.0), ("WARN: som.headroom_b is off the formula by more than 5 %",)),
    (("refresh_trigger", None), ("FAIL: refresh_trigger.default_interval is required",)),
    (("reasoning", "too short"), ("WARN: reasoning is too short or too long",)),
    (("porter_forces", None), ("FAIL: porter_forces must be an object",)),
)
MOAT_CHANGES = (
    ((), ()),
    (("claimed_moats", []), ("FAIL: claimed_moats must be an array that isn't empty",)),
    (("claimed_moats", [{"moat_type": "Luck", "evidence": ""}]), ("FAIL: claimed_moats has an unknown moat_type", "FAIL: claimed_moats lacks evidence")),
    (("vrio_breakdown.score", 3.0), ("WARN: vrio_breakdown.score isn't the sum of its parts",)),
    (("erosion_risks", {}), ("FAIL: erosion_risks must be an array",)),
    (("dominant_moat_required", 1), ("FAIL: dominant_moat_required isn't part of the schema",)),
)
EVALUATION_CHANGES = (
    ((), ()),
    (("archetype", "x"), ("FAIL: archetype isn't part of the schema",)),
    (("mu_breakdown.h_check", {}), ("FAIL: mu_breakdown.h_check isn't part of the schema",)),
    (("aggregate.weights_used", {"m": 0.5}), ("FAIL: aggregate.weights_used must have m and u",)),
    (("aggregate.weights_used", {"m": 0.5, "u": 0.6}), ("FAIL: aggregate.weights_used must add up to 1",)),
    (("dominant_driver.dim", "H"), ("FAIL: dominant_driver.dim isn't one of M, U",)),
    (("metadata.framework_version", "v2"), ("WARN: metadata.framework_version isn't v1.5",)),
    (("metadata.retrieval_window", ["2012"]), ("FAIL: metadata.retrieval_window must be a pair of days",)),
)


def changed(doc: dict, place: str, value) -> dict:
    doc = copy.deepcopy(doc)
    *keys, last = place.split(".")
    at = doc
    for k in keys:
        at = at[k]
    if value is None:
        at.pop(last)
    else:
        at[last] = value
    return doc


def _checked(messages, sound, changes):
    def query(spark, sf_dir):
        texts = F.array(*[F.lit(json.dumps(changed(sound, *c) if c else sound, ensure_ascii=False)) for c, _ in changes], F.lit("[1]"), F.lit("no json"))
        k = F.col("o_orderkey")
        rows = a.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(texts, (k % (len(changes) + 2) + 1).cast("int")).alias("text"))
        return rows.select("o_orderkey", F.array_join(messages(F.col("text")), "|").alias("messages"))

    return query


def _twin(changes, bad=("FAIL: the document must be an object",) * 2):
    said = ["|".join(wrong) for _, wrong in changes] + list(bad)
    listed = ", ".join("'" + s.replace("'", "''") + "'" for s in said)
    return f"SELECT o_orderkey, [{listed}][o_orderkey % {len(said)} + 1] AS messages FROM orders"


CARD = "**Slug**: x\n**Public/private**: `public`\n**Founding year**: 2015\n**Closest existing vendor analogues**: y\n**Original proposal description**: a tool\n---\n\n" + "\n".join(f"## {k}. {s}\n{'word ' * 60}\n- risk one\n" for k, s in enumerate(checks.CARD_SECTIONS, 1))
CARDS = (
    (CARD, ()),
    (CARD.replace("2015", "2150"), ("FAIL: the founding year is out of range",)),
    (CARD.replace("2015", "soon"), ("FAIL: the founding year is no year",)),
    (CARD.replace("**Slug**: x\n", ""), ("FAIL: field Slug is missing",)),
    (CARD.replace("Cost structure", "Costs"), ("FAIL: section Cost structure is missing",)),
    (CARD.replace("- risk one", ""), ("FAIL: no risk is listed",)),
    ("**Archetype**: y\n" + CARD, ("FAIL: an archetype is not allowed",)),
)


def card_checks(spark, sf_dir):
    cards = F.array(*[F.lit(text) for text, _ in CARDS])
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(cards, (F.col("o_orderkey") % len(CARDS) + 1).cast("int")).alias("card"))
    return rows.select("o_orderkey", F.array_join(checks.card_messages(F.col("card")), "|").alias("messages"))


def score_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.floor(k / n) % len(xs) + 1).cast("int"))
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", pick(1, "PASS", "WARN", "FAIL", "GOOD").alias("m"), pick(4, "PASS", "FAIL").alias("u"), pick(8, "PASS", "WARN", "FAIL").alias("v"), (pick(24, 0, 25, 50, 75, 100) / 100).alias("s"))
    return rows.select("o_orderkey", F.array_join(checks.score_messages(F.col("m"), F.col("u"), F.col("v"), F.col("s")), "|").alias("messages"))


def filled_queries(spark, sf_dir):
    """Search queries of two templates, and which of them lack a value."""
    k = F.col("c_custkey")
    rows = a.table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_mktsegment")).alias("target_market"), F.when(k % 4 > 0, k.cast("string")).alias("year"))
    return documents.search_queries(spark, rows, ("{{target_market}} size {{year}}", "{{target_market}} trends"), "c_custkey")


QUERIES = {
    "market_documents": (_checked(documents.market_messages, MARKET, MARKET_CHANGES), _twin(MARKET_CHANGES)),
    "moat_documents": (_checked(documents.moat_messages, MOAT, MOAT_CHANGES), _twin(MOAT_CHANGES)),
    "evaluation_documents": (_checked(documents.evaluation_messages, EVALUATION, EVALUATION_CHANGES), _twin(EVALUATION_CHANGES)),
    "card_checks": (card_checks, _twin(tuple((None, wrong) for _, wrong in CARDS), ())),
    "score_checks": (score_checks, """WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS m, (o_orderkey // 4) % 2 * 2 AS u, (o_orderkey // 8) % 3 AS v, (o_orderkey // 24) % 5 * 25 / 100.0 AS s FROM orders),
      e AS (SELECT *, CASE WHEN m < 3 THEN ((2 - m) / 2.0 + (2 - u) / 2.0) / 2 END AS x FROM p), y AS (SELECT *, CASE WHEN x >= 0.5 THEN 0 WHEN x >= 0.25 THEN 1 ELSE 2 END AS w FROM e)
      SELECT o_orderkey, concat_ws('|', CASE WHEN m = 3 THEN 'FAIL: M is no verdict' END, CASE WHEN m < 3 AND abs(s - x) > 0.005 THEN 'FAIL: the score doesn''t follow from M and U' END, CASE WHEN m < 3 AND v <> w THEN 'FAIL: the verdict doesn''t follow from the score' END) AS messages FROM y"""),
    "filled_queries": (filled_queries, """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '<null:target_market>' END AS t, CASE WHEN c_custkey % 4 > 0 THEN c_custkey::VARCHAR ELSE '<null:year>' END AS y FROM customer)
      SELECT c_custkey, 0 AS query_no, t || ' size ' || y AS query, c_custkey % 3 = 0 OR c_custkey % 4 = 0 AS unresolved FROM p UNION ALL SELECT c_custkey, 1, t || ' trends', c_custkey % 3 = 0 FROM p"""),
}
