"""Sequences in one pass and over exploded rows, against every combination of events tried out."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from eventloom.operators import sequences
from eventloom.plans import rules
from tests.conftest import rows

SCHEMA = "chain_id string, event_id string, family string, event_type string, participant_key string, investor_id string, lo date, hi date"
DAY = dt.date(2024, 1, 1)


def seq(*types, low=None, high=None, same=()):
    steps = [{"scope": "middle_events", "family": "any", "where": [{"field": "event.event_type", "cmp": "in", "value": list(t)}]} for t in types]
    return {"op": "sequence", "steps": steps, "ordering": "strict_before", "min_gap_days": low, "max_gap_days": high, "same_values": [f"event.{f}" for f in same]}


RULES = [
    seq("a", "b"), seq("a", "a"), seq("a", "b", "c"), seq("ab", "b", "bc", "a"), seq("a", "b", low=0), seq("a", "b", low=5), seq("a", "b", "c", low=3), seq("a", "b", high=20), seq("a", "b", high=0), seq("a", "b", "a", high=40),
    seq("a", "b", "c", low=2, high=35), seq("a", "b", "c", "d", low=1, high=400), seq("a", "b", same=("participant_key",)), seq("a", "ab", "b", same=("participant_key",)), seq("ab", "ab", low=2, high=60, same=("participant_key", "investor_id")), seq("a", "b", "a", high=90, same=("investor_id",)),
]


def interval(rnd):
    day = DAY + dt.timedelta(days=rnd.randint(0, 250))
    kind = rnd.random()
    if kind < 0.15:
        return None, None
    if kind < 0.75:
        return day, day
    if kind < 0.92:
        first = day.replace(day=1)
        return first, (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    return dt.date(day.year, 1, 1), dt.date(day.year, 12, 31)


def chain(rnd, name, n):
    return [(name, f"{name}-{k}", rnd.choice(["exposure", "interface"]), rnd.choice("abcd"), rnd.choice(["p", "q", None]), rnd.choice(["i", "j", None]), *interval(rnd)) for k in range(n)]


def holds(rule, events):
    types = [s["where"][0]["value"] for s in rule["steps"]]
    same = [{"event.participant_key": 4, "event.investor_id": 5}[f] for f in rule["same_values"]]
    low, high = rule["min_gap_days"], rule["max_gap_days"]

    def after(step, before, first):
        for e in events:
            if e[6] is None or e[3] not in types[step] or any(e[c] is None or first is not None and e[c] != first[c] for c in same):
                continue
            if before is not None and not (before[7] < e[6] and (low is None or (e[6] - before[7]).days >= low) and (high is None or (e[7] - before[6]).days <= high)):
                continue
            if step + 1 == len(types) or after(step + 1, e, first or e):
                return True
        return False

    return after(0, None, None)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(11)
    made = [e for k in range(240) for e in chain(rnd, f"c{k}", rnd.randint(1, 14))]
    return made, spark.createDataFrame(made, SCHEMA).cache()


def test_one_pass_and_exploded_rows_equal_all_combinations(spark, events):
    made, df = events
    by_chain = {}
    for e in made:
        by_chain.setdefault(e[0], []).append(e)
    packed = df.groupBy("chain_id").agg(F.collect_list(F.struct(*df.columns)).alias("events"))
    flags = {r["chain_id"]: r for r in packed.select("chain_id", *[rules.compile_rule(r).alias(f"r{k}") for k, r in enumerate(RULES)]).collect()}
    for k, rule in enumerate(RULES):
        want = {c for c, es in by_chain.items() if holds(rule, es)}
        assert {c for c, r in flags.items() if r[f"r{k}"]} == want, rule
        if k in (2, 6, 10, 14):
            assert {r[0] for r in sequences.matches(df, rule).collect()} == want, rule
    assert any(0 < sum(r[f"r{k}"] for r in flags.values()) < len(by_chain) for k in range(len(RULES)))


@pytest.mark.parametrize("rule", [RULES[1], RULES[7], RULES[11], RULES[12], RULES[15]])
def test_exploded_rows(spark, events, rule):
    made, df = events
    by_chain = {}
    for e in made:
        by_chain.setdefault(e[0], []).append(e)
    assert {r[0] for r in sequences.matches(df, rule).collect()} == {c for c, es in by_chain.items() if holds(rule, es)}


def test_hot_chain_in_linear_time(spark):
    """10,000 events and four steps that never fit: nested loops would look at 10^12 combinations and more."""
    n = 10_000
    hot = [("hot", str(k), "exposure", "abcd"[min(3, 4 * (n - k) // n)], None, None, DAY + dt.timedelta(days=k // 3), DAY + dt.timedelta(days=k // 3)) for k in range(n)]
    df = spark.createDataFrame(hot, SCHEMA)
    rule, fits = seq("a", "b", "c", "d", low=1, high=300), seq("d", "c", "b", "a", low=1, high=3000)
    packed = df.groupBy("chain_id").agg(F.collect_list(F.struct(*df.columns)).alias("events"))
    began = time.time()
    found = packed.select(rules.compile_rule(rule).alias("no"), rules.compile_rule(fits).alias("yes")).first()
    assert (found.no, found.yes) == (False, True) and time.time() - began < 60
    assert sequences.matches(df, rule).count() == 0 and rows(sequences.matches(df, fits)) == [("hot",)]


def test_sequences_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sequences.matches(none, RULES[2]).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), ("c", None, None, None, None, None, DAY, DAY)], SCHEMA)
    assert sequences.matches(nulls, RULES[0]).count() == 0
    empty = spark.createDataFrame([("c", [])], f"chain_id string, events array<struct<{', '.join(c.replace(' ', ':', 1) for c in SCHEMA.split(', '))}>>")
    assert not empty.select(rules.compile_rule(RULES[12]).alias("x")).first().x
