"""Two-proportion tests, intervals and scores, as Columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ALPHA, DELTA = 0.05, 0.05
#: The quantiles that the p-values are compared through (chi-square with one degree of freedom at 0.95; normal at 0.95), and Wilson's z.
CHI2_CUT, Z_CUT, WILSON_Z = 3.841458820694124, 1.6448536269514722, 1.96


@F.pandas_udf(DoubleType())
def chi2_p(chi2: pd.Series) -> pd.Series:
    """The p-value of a chi-square with one degree of freedom."""
    return chi2.map(lambda x: math.erfc(math.sqrt(x / 2)) if x is not None and x == x else None)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))) if x is not None and x == x else None)


def ate(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """Difference of the success rates of takers (s1 of n1) and others (s0 of n0)."""
    return s1 / n1 - s0 / n0


def chi_square(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """Pearson's chi-square of the 2 x 2 table, without continuity correction; 0 where a margin is empty."""
    n, s = n1 + n0, s1 + s0
    cross = (s1 * (n0 - s0) - s0 * (n1 - s1)).cast("double")
    below = n1.cast("double") * n0 * s * (n - s)
    return F.when(below == 0, 0.0).otherwise(n * cross * cross / below)


def equivalent(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """Whether two one-sided tests at ALPHA place the difference within DELTA (unpooled error)."""
    p1, p0 = s1 / n1, s0 / n0
    error = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    gap = p1 - p0
    return F.when(error == 0, F.abs(gap) < DELTA).otherwise(((gap + DELTA) / F.nullif(error, F.lit(0.0)) > Z_CUT) & ((gap - DELTA) / F.nullif(error, F.lit(0.0)) < -Z_CUT))


def action_value(s1: Column, n1: Column, s0: Column, n0: Column) -> Column:
    """RECOMMEND, AVOID, INDIFFERENT or INCONCLUSIVE; patterns that none or all take have too little support."""
    gap = ate(s1, n1, s0, n0)
    clear = F.when(gap > 0, "RECOMMEND").when(gap < 0, "AVOID").otherwise("INDIFFERENT")
    found = F.when(chi_square(s1, n1, s0, n0) > CHI2_CUT, clear).when(equivalent(s1, n1, s0, n0), "INDIFFERENT").otherwise("INCONCLUSIVE")
    return F.when((n1 == 0) | (n0 == 0), "INSUFFICIENT_PATTERN_SUPPORT").otherwise(found)


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    return F.when((precision == 0) & (recall == 0), 0.0).otherwise((1 + b2) * precision * recall / (b2 * precision + recall))


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's interval of a proportion; 0 and 0 without trials."""
    z2 = WILSON_Z * WILSON_Z
    below = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / below
    spread = WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / below
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + spread))


def aggregate_score(m: Column, u: Column) -> Column:
    """The mean of two dimension scores: a WARN counts half a PASS."""
    value = lambda v: F.when(v == "PASS", 1.0).when(v == "WARN", 0.5).otherwise(0.0)
    return (value(m) + value(u)) / 2


def aggregate_verdict(score: Column) -> Column:
    return F.when(score >= 0.5, "PASS").when(score >= 0.25, "WARN").otherwise("FAIL")


def dominant_driver(m: Column, u: Column) -> Column:
    """The dimension with the worse verdict; M when they tie."""
    rank = lambda v: F.when(v == "FAIL", 0).when(v == "WARN", 1).otherwise(2)
    return F.when(rank(u) < rank(m), "U").otherwise("M")


def market_score(dollars: Column) -> Column:
    """0 at 10 million, 1 at 10 billion, in proportion to the logarithm; 0 without a size."""
    return F.when(dollars > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(dollars) - 7) / 3))).otherwise(0.0)


def moat_score(marks: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), marks / 4))


def headroom_ok(tam: Column, share: Column, locked: Column, discount: Column, stated: Column) -> Column:
    """Whether a stated market is within 5 % of tam * share * (1 - locked) * discount."""
    expected = tam * share * (1 - locked) * discount
    return F.abs(stated - expected) <= 0.05 * expected
