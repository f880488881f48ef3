"""The rule language over chains: check, canonical form, compilation to a Column, rendering.

A rule is a JSON tree. It is compiled at the driver into one boolean Column over a row with

* ``chain``: a struct of the chain's columns,
* ``derived``: a struct of derived fields (see operators.context),
* ``events``: an array of structs with the event fields and ``lo``, ``hi``, ``batch`` and
  ``family_batch`` (batch numbers over all events and over the event's family).

Comparisons have two values, not SQL's three: null equals null, null differs from anything
else, null is in no list, and an order comparison with null is false; with a chain field
that is null it is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that rules may name.
CHAIN_SCALARS = (
    "chain_id", "company_id", "company_label_v4", "chain_sequence", "chain_start_date", "chain_start_reason", "chain_end_date",
    "chain_window_status", "outcome_type", "outcome_round", "n_participant_rows", "n_exposure", "n_interface",
)
CHAIN_LISTS = ("outcome_event_ids", "investor_ids", "investor_raw_names", "exposure_event_ids", "exposure_types", "interface_event_ids", "interface_types")
DERIVED = (
    "n_middle", "n_raw_outcome_investors", "n_resolved_outcome_investors", "outcome_investor_count", "outcome_investor_basis",
    "chain_duration_days", "outcome_round_bucket", "outcome_round_known", "n_prior_chains", "company_chain_count", "is_last_chain",
    "chain_position_bucket", "prior_same_round_count", "round_occurrence_index", "days_since_previous_same_round",
    "prior_outcome_investor_overlap_count", "prior_outcome_investor_overlap_ratio", "has_prior_outcome_investor_overlap",
    "n_ordered_batches", "n_comparable_gaps", "n_known_date_middle_events", "middle_span_min", "middle_span_max",
    "min_interbatch_gap_min", "min_interbatch_gap_max", "max_interbatch_gap_min", "max_interbatch_gap_max",
    "n_unique_interface_investors_resolved", "n_unique_interface_raw_names", "interface_investor_count", "interface_investor_basis",
    "exposure_share", "interface_share", "events_per_chain_year", "batches_per_chain_year",
    *(f"first_{f}_after_start_{b}" for f in ("any", "exposure", "interface") for b in ("min", "max")),
    *(f"last_{f}_before_end_{b}" for f in ("any", "exposure", "interface") for b in ("min", "max")),
)
EVENT = (
    "event_id", "family", "event_type", "event_subtype", "event_date", "date_precision", "date_min", "date_max", "investor_id",
    "raw_investor_name", "participant_key", "participant_basis", "days_before_chain_end_min", "days_before_chain_end_max",
    "days_after_chain_start_min", "days_after_chain_start_max",
)
FIELDS = {"chain": CHAIN_SCALARS + CHAIN_LISTS, "derived": DERIVED, "event": EVENT}
ORDERED = ("lt", "lte", "gt", "gte")
COMPARATORS = ("eq", "ne", *ORDERED, "in", "not_in", "is_null", "not_null")
FAMILIES = ("any", "exposure", "interface")
TRACKS = ("ACTION_ELIGIBLE", "DESCRIPTIVE_ASSOCIATION")


class RuleError(ValueError):
    """What is wrong with a rule, and where."""


# ---------------------------------------------------------------- checks


def _need(ok: bool, at: str, what: str) -> None:
    if not ok:
        raise RuleError(f"{at}: {what}")


def _shape(node, at: str, keys: tuple[str, ...], maybe: tuple[str, ...] = ()) -> None:
    _need(isinstance(node, dict), at, "an object is expected")
    for k in node:
        _need(k in keys or k in maybe, f"{at}.{k}", "unknown key")
    for k in keys:
        _need(k in node, f"{at}.{k}", "missing key")


def _choice(value, options, at: str) -> None:
    _need(any(value is o or (type(value) is type(o) and value == o) for o in options), at, f"one of {', '.join(map(str, options))} is expected")


def check_field(name, at: str, spaces: tuple[str, ...]) -> None:
    space, _, field = name.partition(".") if isinstance(name, str) else ("", "", "")
    _need(space in spaces and field in FIELDS[space], at, f"unknown field {name!r}")


def check_selector(node, at: str) -> None:
    _shape(node, at, ("scope", "family", "where"))
    _choice(node["scope"], ("middle_events",), f"{at}.scope")
    _choice(node["family"], FAMILIES, f"{at}.family")
    _need(isinstance(node["where"], list), f"{at}.where", "an array is expected")
    for k, test in enumerate(node["where"]):
        here = f"{at}.where[{k}]"
        _shape(test, here, ("field", "cmp"), ("value",))
        check_field(test["field"], f"{here}.field", ("event",))
        _check_operand(test, "value", here)
        _need(not isinstance(test.get("value"), dict), f"{here}.value", "a scalar or an array is expected")


def _check_operand(node: dict, key: str, at: str) -> None:
    _choice(node["cmp"], COMPARATORS, f"{at}.cmp")
    unary = node["cmp"] in ("is_null", "not_null")
    _need((key in node) != unary, f"{at}.{key}", "forbidden here" if unary else "missing key")


def check_value(node, at: str) -> None:
    _need(isinstance(node, dict) and len(node) == 1, at, "an object with one construct is expected")
    [(kind, body)] = node.items()
    here = f"{at}.{kind}"
    if kind == "field":
        check_field(body, here, ("chain", "derived"))
    elif kind == "literal":
        _need(not isinstance(body, dict), here, "a scalar or an array is expected")
    elif kind == "event_count":
        check_selector(body, here)
    elif kind == "event_timing":
        _shape(body, here, ("selector", "relative_to", "edge", "bound"))
        check_selector(body["selector"], f"{here}.selector")
        for key, options in (("relative_to", ("start", "end")), ("edge", ("first", "last")), ("bound", ("min", "max"))):
            _choice(body[key], options, f"{here}.{key}")
    elif kind == "event_position":
        _shape(body, here, ("selector", "scope", "edge"))
        check_selector(body["selector"], f"{here}.selector")
        for key, options in (("scope", ("family", "all_middle")), ("edge", ("first_batch", "last_batch"))):
            _choice(body[key], options, f"{here}.{key}")
        _need(body["scope"] != "family" or body["selector"]["family"] != "any", f"{here}.scope", "a position in the family needs one family")
    elif kind == "event_distinct_count":
        _shape(body, here, ("selector", "field"))
        check_selector(body["selector"], f"{here}.selector")
        _choice(body["selector"]["family"], ("interface",), f"{here}.selector.family")
        _choice(body["field"], ("event.participant_key",), f"{here}.field")
    elif kind == "value_count":
        options = ("distinct", "strip_strings", "ignore_null", "ignore_empty")
        _shape(body, here, ("field", *options))
        check_field(body["field"], f"{here}.field", ("chain",))
        _need(body["field"][6:] in CHAIN_LISTS, f"{here}.field", "a list is expected")
        for key in options:
            _choice(body[key], (True, False), f"{here}.{key}")
    else:
        raise RuleError(f"{here}: unknown construct")


def check_rule(node, at: str = "$") -> None:
    _need(isinstance(node, dict), at, "an object is expected")
    op = node.get("op")
    if op in ("all", "any"):
        _shape(node, at, ("op", "rules"))
        _need(isinstance(node["rules"], list) and bool(node["rules"]), f"{at}.rules", "an array that isn't empty is expected")
        for k, child in enumerate(node["rules"]):
            check_rule(child, f"{at}.rules[{k}]")
    elif op == "not":
        _shape(node, at, ("op", "rule"))
        check_rule(node["rule"], f"{at}.rule")
    elif op in ("present", "absent"):
        _shape(node, at, ("op", "selector"))
        check_selector(node["selector"], f"{at}.selector")
    elif op == "compare":
        _shape(node, at, ("op", "left", "cmp"), ("right",))
        check_value(node["left"], f"{at}.left")
        _check_operand(node, "right", at)
        if "right" in node:
            check_value(node["right"], f"{at}.right")
    elif op == "sequence":
        _shape(node, at, ("op", "steps", "ordering", "min_gap_days", "max_gap_days", "same_values"))
        _need(isinstance(node["steps"], list) and len(node["steps"]) >= 2, f"{at}.steps", "two steps or more are expected")
        for k, step in enumerate(node["steps"]):
            check_selector(step, f"{at}.steps[{k}]")
        _choice(node["ordering"], ("strict_before",), f"{at}.ordering")
        for key in ("min_gap_days", "max_gap_days"):
            _need(node[key] is None or (type(node[key]) is int and node[key] >= 0), f"{at}.{key}", "null or a number of days is expected")
        if None not in (low := node["min_gap_days"], high := node["max_gap_days"]):
            _need(low <= high, at, "the least gap is over the largest")
        same = node["same_values"]
        _need(isinstance(same, list) and len(set(map(str, same))) == len(same), f"{at}.same_values", "an array without repeats is expected")
        for k, field in enumerate(same):
            check_field(field, f"{at}.same_values[{k}]", ("event",))
    else:
        raise RuleError(f"{at}.op: unknown operator {op!r}")


def check_pattern_set(payload) -> dict:
    """The payload, if it is a sound pattern set; its digest is added as ``sha256``."""
    _shape(payload, "$", ("config_schema_version", "pattern_set_id", "primary_order", "patterns"))
    _choice(payload["config_schema_version"], ("1.0",), "$.config_schema_version")
    _need(isinstance(payload["patterns"], list) and bool(payload["patterns"]), "$.patterns", "an array that isn't empty is expected")
    ids = []
    for k, p in enumerate(payload["patterns"]):
        at = f"$.patterns[{k}]"
        _shape(p, at, ("id", "name", "description", "evaluation_status", "not_evaluable_reason", "rule"), ("track",))
        for key in ("id", "name", "description"):
            _need(isinstance(p[key], str) and bool(p[key].strip()), f"{at}.{key}", "text is expected")
        _need(re.fullmatch("[A-Za-z][A-Za-z0-9_]*", p["id"]) is not None and p["id"] not in ids, f"{at}.id", "a new identifier is expected")
        ids.append(p["id"])
        _choice(p.get("track"), (None, *TRACKS), f"{at}.track")
        _choice(p["evaluation_status"], ("EVALUABLE", "NOT_EVALUABLE"), f"{at}.evaluation_status")
        if p["evaluation_status"] == "EVALUABLE":
            _need(p["not_evaluable_reason"] is None, f"{at}.not_evaluable_reason", "null is expected")
            check_rule(p["rule"], f"{at}.rule")
        else:
            _need(p["rule"] is None, f"{at}.rule", "null is expected")
            _need(bool(p["not_evaluable_reason"]), f"{at}.not_evaluable_reason", "text is expected")
    _need(isinstance(payload["primary_order"], list) and sorted(payload["primary_order"]) == sorted(ids), "$.primary_order", "every identifier once is expected")
    return payload | {"sha256": hashlib.sha256(canonical_json(payload).encode()).hexdigest()}


# ---------------------------------------------------------------- canonical form


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse(text: str) -> dict:
    """A rule from its canonical text, checked."""
    rule = json.loads(text)
    check_rule(rule)
    return rule


def _selector(node: dict) -> dict:
    tests = []
    for t in node["where"]:
        if t["cmp"] in ("eq", "ne") and t["value"] is not None and not isinstance(t["value"], list):
            t = {"field": t["field"], "cmp": {"eq": "in", "ne": "not_in"}[t["cmp"]], "value": [t["value"]]}
        if t["cmp"] in ("in", "not_in") and isinstance(t["value"], list):
            t = t | {"value": sorted({canonical_json(v): v for v in t["value"]}.values(), key=canonical_json)}
        tests.append(t)
    return node | {"where": sorted({canonical_json(t): t for t in tests}.values(), key=canonical_json)}


def canonical(rule: dict) -> dict:
    """The same rule in one form: nested all/any flattened, absences of a family merged, children sorted and single."""
    op = rule["op"]
    if op in ("present", "absent"):
        return rule | {"selector": _selector(rule["selector"])}
    if op == "sequence":
        return rule | {"steps": [_selector(s) for s in rule["steps"]], "same_values": sorted(rule["same_values"])}
    if op == "not":
        child = canonical(rule["rule"])
        return child["rule"] if child["op"] == "not" else {"op": "not", "rule": child}
    if op not in ("all", "any"):
        return rule
    children = []
    for child in map(canonical, rule["rules"]):
        children += child["rules"] if child["op"] == op else [child]
    if op == "all":
        children = _merge_absences(children)
    children = sorted({canonical_json(c): c for c in children}.values(), key=canonical_json)
    return children[0] if len(children) == 1 else {"op": op, "rules": children}


def _merge_absences(children: list[dict]) -> list[dict]:
    """Absences that name one set of values of one field each become a single absence of their union."""
    merged: dict[tuple, list] = {}
    rest = []
    for c in children:
        tests = c["selector"]["where"] if c["op"] == "absent" else ()
        if len(tests) == 1 and tests[0]["cmp"] == "in" and isinstance(tests[0]["value"], list):
            merged.setdefault((c["selector"]["family"], tests[0]["field"]), []).extend(tests[0]["value"])
        else:
            rest.append(c)
    for (family, field), values in merged.items():
        rest.append({"op": "absent", "selector": _selector({"scope": "middle_events", "family": family, "where": [{"field": field, "cmp": "in", "value": values}]})})
    return rest


def rule_id(prefix: str, rule: dict) -> str:
    return prefix + hashlib.sha256(canonical_json(canonical(rule)).encode()).hexdigest()[:24]


def materializable(rule: dict, atoms: set[str], prefix: str, most_all: int = 4, most_any: int = 3) -> list[str]:
    """The identifiers of the atoms that a formula is put together from, in order; an error where a frozen grammar doesn't allow it.

    all takes 2 to ``most_all`` children, one ``any`` among them at most, and no other all;
    any takes 2 to ``most_any`` atoms. Every atom must be among ``atoms``.
    """
    leaves: list[dict] = []

    def walk(node: dict, inside: str) -> None:
        if node["op"] not in ("all", "any"):
            leaves.append(node)
            return
        children, most = node["rules"], most_all if node["op"] == "all" else most_any
        _need(2 <= len(children) <= most, "$", f"{node['op']} takes 2 to {most} rules")
        _need(inside == "" or inside == "all" and node["op"] == "any", "$", f"{node['op']} inside {inside}")
        _need(sum(c["op"] == "any" for c in children) <= 1, "$", "one any at most")
        for child in children:
            walk(child, node["op"])

    walk(rule, "")
    found = sorted({rule_id(prefix, leaf) for leaf in leaves})
    _need(set(found) <= atoms, "$", "atoms that aren't frozen: " + ", ".join(sorted(set(found) - atoms)))
    return found


def complexity(node) -> int:
    """Objects in the tree that carry an operator, a construct or a test."""
    if isinstance(node, dict):
        return 1 + sum(map(complexity, node.values()))
    return sum(map(complexity, node)) if isinstance(node, list) else 0


def fields_of(node) -> set[str]:
    if isinstance(node, dict):
        return {v for k, v in node.items() if k == "field" and isinstance(v, str)} | {x for v in node.values() for x in fields_of(v)} | set(node.get("same_values", ()))
    return {x for v in node for x in fields_of(v)} if isinstance(node, list) else set()


# ---------------------------------------------------------------- compilation


def compare(left: Column, cmp: str, right, chain_field: str | None = None) -> Column:
    """A two-valued comparison. right: a Column or a JSON literal; chain_field: left's name, if it is a chain field."""
    if cmp == "is_null":
        return left.isNull()
    if cmp == "not_null":
        return left.isNotNull()
    if cmp in ("in", "not_in"):
        if isinstance(right, Column):
            inside = F.coalesce(F.array_contains(right, left), F.lit(False))
        elif isinstance(right, str):
            inside = F.coalesce(F.lit(right).contains(left), F.lit(False))
        else:
            values = [v for v in right or () if v is not None]
            inside = F.coalesce(left.isin(*values), F.lit(False)) if values else F.lit(False)
            inside = inside | left.isNull() if right and None in right else inside
        return inside if cmp == "in" else ~inside
    right = right if isinstance(right, Column) else F.lit(right)
    if cmp in ("eq", "ne"):
        same = left.eqNullSafe(right)
        return same if cmp == "eq" else ~same
    found = {"lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[cmp]
    found = F.coalesce(found, F.lit(False))
    if chain_field:
        return F.when(left.isNull(), F.raise_error(F.lit(f"{chain_field} is null in an order comparison")).cast("boolean")).otherwise(found)
    return found


def event_test(selector: dict) -> Callable[[Column], Column]:
    tests = [(t["field"][6:], t["cmp"], t.get("value")) for t in selector["where"]]

    def test(event: Column) -> Column:
        found = [] if selector["family"] == "any" else [event["family"] == selector["family"]]
        found += [compare(event[field], cmp, value) for field, cmp, value in tests]
        return reduce(lambda a, b: a & b, found, F.lit(True)) if found else F.lit(True)

    return test


def bound_to(value: Column, of_value: Callable[[Column], Column]) -> Column:
    """What ``of_value`` makes of a value that is evaluated once, also where lambdas use it for each of many events."""
    return F.transform(F.array(value), of_value)[0]


def timing(events: Column, prefix: str, edge: str, bound: str) -> Column:
    """The least or largest distance of the events that may be the first (or last) one. Time is linear in the events."""
    dated = F.filter(events, lambda e: e["lo"].isNotNull() & e[f"{prefix}_{bound}"].isNotNull() & (e["hi"].isNotNull() if edge == "last" else F.lit(True)))
    least = lambda values: F.array_min(values) if bound == "min" else F.array_max(values)

    def of_dated(dated: Column) -> Column:
        # The latest end of those that start first, or the earliest start of those that end last.
        if edge == "first":
            limit = F.array_max(F.transform(dated, lambda e: F.struct((-F.unix_date(e["lo"])).alias("first"), e["hi"].alias("limit"))))["limit"]
        else:
            limit = F.array_min(F.transform(dated, lambda e: F.struct((-F.unix_date(e["hi"])).alias("last"), e["lo"].alias("limit"))))["limit"]
        near = lambda e, limit: e["lo"] <= limit if edge == "first" else e["hi"] >= limit
        return bound_to(limit, lambda limit: least(F.transform(F.filter(dated, lambda e: near(e, limit)), lambda e: e[f"{prefix}_{bound}"])))

    return bound_to(dated, of_dated)


def compile_value(node: dict) -> Column:
    [(kind, body)] = node.items()
    if kind == "field":
        return F.col(body)
    if kind == "literal":
        return F.array(*map(F.lit, body)) if isinstance(body, list) else F.lit(body)
    if kind == "event_count":
        return F.size(F.filter("events", event_test(body)))
    if kind == "event_timing":
        chosen = F.filter("events", event_test(body["selector"]))
        found = timing(chosen, {"start": "days_after_chain_start", "end": "days_before_chain_end"}[body["relative_to"]], body["edge"], body["bound"])
        known = F.col("chain.chain_start_date") != "founding" if body["relative_to"] == "start" else F.col("chain.chain_window_status") == "dated"
        return F.when(known, found)
    if kind == "event_position":
        field = "batch" if body["scope"] == "all_middle" else "family_batch"
        family = body["selector"]["family"]
        mine = F.col("events") if body["scope"] == "all_middle" else F.filter("events", lambda e: e["family"] == family)
        numbers = F.transform(mine, lambda e: e[field])
        edge = F.array_min(numbers) if body["edge"] == "first_batch" else F.array_max(numbers)
        test = event_test(body["selector"])
        return F.coalesce(F.exists("events", lambda e: test(e) & e[field].eqNullSafe(edge) & edge.isNotNull()), F.lit(False))
    if kind == "event_distinct_count":
        keys = F.transform(F.filter("events", event_test(body["selector"])), lambda e: e["participant_key"])
        return F.size(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != ""))))
    values = F.col(body["field"])
    values = F.filter(values, lambda v: v.isNotNull()) if body["ignore_null"] else values
    values = F.transform(values, lambda v: F.trim(v)) if body["strip_strings"] else values
    values = F.filter(values, lambda v: ~v.eqNullSafe("")) if body["ignore_empty"] else values
    return F.size(F.array_distinct(values) if body["distinct"] else values)


def compile_sequence(rule: dict) -> Column:
    """One pass over the events by ascending ``lo``, with what has been reached of each step.

    An event can follow a step whose event has ended ``gap`` days before it starts. Events
    come by ``lo``, so that limit only grows, and whatever it passes stays passed. Without a largest
    gap a step needs its earliest end. With one it needs the latest start among the events
    that the limit has passed, and those still waiting: an event that starts later and ends no later makes a
    waiting one needless, so at most one waits for each end. Where fields must be
    the same, events are sorted by them first, and what was reached is forgotten when they change.
    """
    tests = [event_test(s) for s in rule["steps"]]
    low, high, same = rule["min_gap_days"], rule["max_gap_days"], [f[6:] for f in rule["same_values"]]
    gap, last = max(1, low or 0), len(tests) - 1
    waiting = "array<struct<hi:date,lo:date>>"

    def usable(e: Column) -> Column:
        return reduce(lambda a, b: a & b, [e[name].isNotNull() for name in same], e["lo"].isNotNull()) & reduce(lambda a, b: a | b, [t(e) for t in tests])

    def role(e: Column) -> Column:
        key = F.struct(*[e[name].alias(f"k{i}") for i, name in enumerate(same)]) if same else F.lit(0)
        return F.struct(key.alias("key"), e["lo"].alias("lo"), e["hi"].alias("hi"), *[t(e).alias(f"t{k}") for k, t in enumerate(tests)])

    def ripe(w: Column, e: Column) -> Column:
        return F.date_add(w["hi"], gap) <= e["lo"]

    def reached(acc: Column, k: int, e: Column) -> Column:
        """The latest start of events of step k that e may follow; without a largest gap, the earliest end of step k."""
        passed = F.array_max(F.transform(F.filter(acc[f"w{k}"], lambda w: ripe(w, e)), lambda w: w["lo"]))
        return F.greatest(acc[f"b{k}"], passed)

    def step(acc: Column, e: Column) -> Column:
        # What was reached under other values of the same fields doesn't count.
        fresh = ~acc["key"].eqNullSafe(e["key"]) if same else F.lit(False)
        made, held = [e["key"].alias("key")], F.lit(False)
        for k in range(last + 1):
            if k:
                if high is None:
                    follows = F.date_add(acc[f"b{k - 1}"], gap) <= e["lo"]
                else:
                    follows = F.date_add(reached(acc, k - 1, e), high) >= e["hi"]
                fits = e[f"t{k}"] & F.coalesce(follows, F.lit(False)) & ~fresh
            else:
                fits = e["t0"]
            if k == last:
                held = fits
            elif high is None:
                before = F.when(~fresh, acc[f"b{k}"])
                made.append(F.when(fits, F.least(before, e["hi"])).otherwise(before).alias(f"b{k}"))
            else:
                made.append(F.when(~fresh, reached(acc, k, e)).alias(f"b{k}"))
                rest = F.when(fresh, F.array().cast(waiting)).otherwise(F.filter(acc[f"w{k}"], lambda w: ~ripe(w, e)))
                mine = F.array(F.struct(e["hi"].alias("hi"), e["lo"].alias("lo")))
                made.append(F.when(fits, F.concat(F.filter(rest, lambda w: w["hi"] < e["hi"]), mine)).otherwise(rest).alias(f"w{k}"))
        return F.struct(*made, (acc["found"] | held).alias("found"))

    order = F.array_sort(F.transform(F.filter("events", usable), role))
    none = F.lit(None).cast("date")
    start = [F.lit(None).alias("key") if same else F.lit(0).alias("key")]
    for k in range(last):
        start += [none.alias(f"b{k}")] + ([F.array().cast(waiting).alias(f"w{k}")] if high is not None else [])
    if same:
        # The key's type is that of the events; a null of it comes from an event that isn't there.
        start[0] = F.try_element_at(order, F.size(order) + 1)["key"].alias("key")
    return F.coalesce(F.aggregate(order, F.struct(*start, F.lit(False).alias("found")), step, lambda acc: acc["found"]), F.lit(False))


def compile_rule(rule: dict) -> Column:
    op = rule["op"]
    if op in ("all", "any"):
        parts = [compile_rule(r) for r in rule["rules"]]
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), parts)
    if op == "not":
        return ~compile_rule(rule["rule"])
    if op in ("present", "absent"):
        found = F.coalesce(F.exists("events", event_test(rule["selector"])), F.lit(False))
        return found if op == "present" else ~found
    if op == "sequence":
        return compile_sequence(rule)
    left = compile_value(rule["left"])
    field = rule["left"].get("field", "")
    right = rule.get("right")
    right = right["literal"] if right and "literal" in right else compile_value(right) if right else None
    return compare(left, rule["cmp"], right, field if field.startswith("chain.") else None)


def flags(patterns: dict) -> list[Column]:
    """A boolean column for each pattern; null for those that can't be evaluated."""
    return [(compile_rule(p["rule"]) if p["evaluation_status"] == "EVALUABLE" else F.lit(None).cast("boolean")).alias(p["id"]) for p in patterns["patterns"]]


def primary(patterns: dict) -> Column:
    """The first pattern of the order that holds; UNMATCHED if none does, NOT_EVALUABLE if none can be evaluated."""
    known = {p["id"] for p in patterns["patterns"] if p["evaluation_status"] == "EVALUABLE"}
    order = [i for i in patterns["primary_order"] if i in known]
    return F.coalesce(*[F.when(F.col(i), i) for i in order], F.lit("UNMATCHED")) if order else F.lit("NOT_EVALUABLE")


# ---------------------------------------------------------------- rendering

_SIGNS = {"eq": "is", "ne": "is not", "lt": "is less than", "lte": "is at most", "gt": "is more than", "gte": "is at least", "in": "is one of", "not_in": "is none of", "is_null": "is missing", "not_null": "is known"}


def _words(value) -> str:
    return ", ".join(map(_words, value)) if isinstance(value, list) else "nothing" if value is None else str(value)


def _events(selector: dict) -> str:
    family = "" if selector["family"] == "any" else f"{selector['family']} "
    tests = " and ".join(f"{t['field'][6:]} {_SIGNS[t['cmp']]} {_words(t['value']) if 'value' in t else ''}".strip() for t in selector["where"])
    return f"{family}event{f' whose {tests}' if tests else ''}"


def _subject(node: dict) -> str:
    [(kind, body)] = node.items()
    if kind == "event_count":
        return f"the number of times an {_events(body)} occurs"
    if kind == "event_timing":
        return f"the {body['bound']} days between the chain's {body['relative_to']} and the {body['edge']} {_events(body['selector'])}"
    if kind == "event_position":
        return f"whether an {_events(body['selector'])} is in the {body['edge'].replace('_', ' ')}"
    if kind == "event_distinct_count":
        return f"the number of participants of an {_events(body['selector'])}"
    if kind == "value_count":
        return f"the number of {body['field'][6:]}"
    return body if kind == "field" else _words(body)


def render(rule: dict) -> str:
    """The rule in English."""
    op = rule["op"]
    if op in ("all", "any"):
        return f" {'and' if op == 'all' else 'or'} ".join(f"({render(r)})" for r in rule["rules"])
    if op == "not":
        return f"not ({render(rule['rule'])})"
    if op in ("present", "absent"):
        return f"{'an' if op == 'present' else 'no'} {_events(rule['selector'])} occurs"
    if op == "sequence":
        gaps = [f"{w} {rule[k]} days apart" for k, w in (("min_gap_days", "at least"), ("max_gap_days", "at most")) if rule[k] is not None]
        same = [f"with the same {f[6:]}" for f in rule["same_values"]]
        return ", ".join([" before ".join(f"an {_events(s)}" for s in rule["steps"]), *gaps, *same])
    return f"{_subject(rule['left'])} {_SIGNS[rule['cmp']]} {_subject(rule['right']) if 'right' in rule else ''}".strip()
