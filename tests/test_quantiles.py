"""Exact quantiles against sorted lists."""

import math
import random
import statistics

import pytest

from eventloom.operators import quantiles
from tests.conftest import rows


@pytest.mark.parametrize("values", [lambda r: r.randint(0, 3), lambda r: r.gauss(0, 1), lambda r: r.choice([1.0, 1.0, 1.0, 5.0, -2.5]), lambda r: float(int(r.paretovariate(0.5)))])
def test_medians(spark, values):
    rnd = random.Random(7)
    sizes = {"one": 1, "two": 2, "odd": 99, "even": 1000, "hot": 20_000, None: 7}
    data = [(k, float(values(rnd))) for k, n in sizes.items() for _ in range(n)] + [("one", None), ("none", None), ("odd", math.nan)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    found = {r.k: r for r in quantiles.medians(df, ["k"], "v", {"q0": 0.0, "q1": 0.25, "q9": 0.9, "q100": 1.0}).collect()}
    assert found.keys() == sizes.keys()
    for k, n in sizes.items():
        mine = sorted(v for i, v in data if i == k and v is not None and not math.isnan(v))
        at = lambda p: mine[max(1, math.ceil(p * n)) - 1]  # noqa: E731, B023
        assert (found[k].n, found[k].median) == (n, statistics.median(mine))
        assert (found[k].q0, found[k].q1, found[k].q9, found[k].q100) == (at(0), at(0.25), at(0.9), at(1.0))


def test_only_a_part_of_the_values_meets_in_the_window(spark):
    """50,000 different values of one key: the running count sees few of them."""
    df = spark.range(50_000).selectExpr("1 AS k", "cast(id * 37 % 50000 AS double) AS v")
    found = quantiles.medians(df, ["k"], "v")
    assert rows(found) == [(1, 50_000, 24_999.5)]
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile(" not in plan


def test_values_of_small_keys_are_not_repeated_for_each_rank(spark):
    """500 keys of 40 values: no more rows come out of the join with the bounds than there are values."""
    df = spark.range(20_000).selectExpr("id % 500 AS k", "cast(id AS double) AS v")
    found = quantiles.medians(df, ["k"], "v", {"q1": 0.25, "q3": 0.75})
    made = {r.k: tuple(r)[1:] for r in found.collect()}
    assert made == {k: (40, 9750.0 + k, 4500.0 + k, 14500.0 + k) for k in range(500)}

    def nodes(plan):
        inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else None
        yield plan
        for p in ([inner] if inner is not None else []) + [plan.children().apply(i) for i in range(plan.children().size())]:
            yield from nodes(p)

    joins = [p for p in nodes(found._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName()]
    assert joins and max(p.metrics().get("numOutputRows").get().value() for p in joins) <= 20_000


def test_histogram_and_nothing(spark):
    df = spark.createDataFrame([("a", -0.5), ("a", 0.0), ("a", 9.99), ("a", 10.0), (None, 3.0), ("b", None)], "k string, v double")
    assert rows(quantiles.histogram(df, ["k"], "v", 10)) == [("a", -1, 1), ("a", 0, 2), ("a", 1, 1), (None, 0, 1)]
    assert quantiles.medians(df.limit(0), ["k"], "v").count() == 0
