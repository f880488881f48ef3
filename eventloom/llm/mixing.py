"""Mixing sources to target weights by temperature.

A source's share of all tokens, raised to an exponent and normalised, is its weight. The
exponent (1 keeps the shares, 0 makes all sources equal) is found by bisection: as flat as
the target entropy asks for, but never so flat that a source would be repeated more often
than the limit. Weights times the budget give each source a quota of tokens.

The mix is realised by block permutations. Epoch after epoch, a source's documents stand in
a pseudo-random order of their own; what lies under the source's quota is placed. Places
are dealt over blocks in proportion, so every block holds each source at its weight, and
within a block they are permuted again. A place is one use of one document.

Orders come from MD5 of seed, epoch and identifier, so they are the same on any cluster.
Running sums of tokens are taken within BUCKETS ranges of that order and joined with the
sums of the ranges before, so that no task holds a whole source.

Defined cases: null text has no tokens; documents without tokens, and sources that have
nothing else, get no place; null is a source of its own; rows that share an identifier are
placed independently, at neighbouring places; with no tokens at all the mix is empty; other
columns play no part. Rows without an identifier are ordered as if it were an empty text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD, WS_CLASS, materialize

STEPS = 50
#: So many steps of the bisection share a job, which evaluates all exponents that they may come to.
STEPS_AT_ONCE = 6
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Target:
    """entropy: of the weights, as a part of the largest possible; repetition: most uses of
    a source on average; budget: tokens of the mix, or None for the least at which every
    source is used once in full, or "corpus" for as many as there are."""

    entropy: float = 0.93
    repetition: float = 4.0
    budget: int | str | None = "corpus"
    block_tokens: int = 200_000
    seed: int = 17


def n_words(text: Column) -> Column:
    """Words between runs of white space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS, " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


class Shares:
    """Entropy and repetition of the weights at an exponent, over (source, tokens > 0). Sources stay where they are."""

    def __init__(self, sources: DataFrame):
        self.sources = sources
        self.n, self.total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self.known: dict[float, tuple[float, float, float, float]] = {}

    def learn(self, exponents: list[float]) -> None:
        """Evaluate the exponents in one job: a row of sums for each comes back."""
        exponents = [x for x in exponents if x not in self.known]
        if not exponents:
            return
        powers = self.sources.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("x"))
        powers = powers.withColumn("power", F.pow(F.col("tokens") / self.total, "x"))
        each = F.col("power") / F.col("tokens")
        for x, *found in powers.groupBy("x").agg(F.sum("power"), F.sum(F.col("power") * F.log("power")), F.max(each), F.min(each)).collect():
            self.known[x] = tuple(found)

    def at(self, exponent: float) -> tuple[float, float, float, float]:
        """(sum of powers, entropy of the weights, the largest weight / tokens, the smallest)."""
        self.learn([exponent])
        whole, logs, most, least = self.known[exponent]
        return whole, math.log(whole) - logs / whole, most / whole, least / whole


def _middles(low: float, high: float, steps: int) -> list[float]:
    """All exponents that so many steps of a bisection may come to."""
    if not steps:
        return []
    middle = (low + high) / 2
    return [middle, *_middles(low, middle, steps - 1), *_middles(middle, high, steps - 1)]


def find_exponent(shares: Shares, target: Target) -> tuple[float, int]:
    """The exponent and the budget in tokens."""

    def budget(least: float) -> float:
        if target.budget is None:
            return 1.0 / least
        return shares.total if target.budget == "corpus" else target.budget

    def too_flat(exponent: float) -> bool:
        _, entropy, most, least = shares.at(exponent)
        return entropy > target.entropy * math.log(shares.n) or most * budget(least) > target.repetition

    low, high = 0.0, 1.0
    shares.learn([low, high, *_middles(low, high, STEPS_AT_ONCE)])
    if not too_flat(low):
        high = low
    elif too_flat(high):
        low = high
    else:
        for step in range(STEPS):
            if step % STEPS_AT_ONCE == 0:
                shares.learn(_middles(low, high, min(STEPS_AT_ONCE, STEPS - step)))
            middle = (low + high) / 2
            low, high = (middle, high) if too_flat(middle) else (low, middle)
    exponent = round(high, 9)
    return exponent, round(budget(shares.at(exponent)[3]))


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per place: doc_id, source, n_tokens, epoch, block, position (in the block, from 1)."""
    source = F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("key"), n_words(F.col(text_col)).alias("n_tokens"))
    rows = materialize(rows.filter("n_tokens > 0"), "tokens")
    sources = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"))
    sources = materialize(sources, "sources")
    shares = Shares(sources)
    exponent, budget = find_exponent(shares, target) if shares.n else (1.0, 0)
    whole = shares.at(exponent)[0] if shares.n else 1.0
    blocks = max(1, math.ceil(budget / target.block_tokens))

    quotas = sources.withColumn("quota", F.round(F.pow(F.col("tokens") / max(shares.total, 1), F.lit(exponent)) / whole * budget).cast("long"))
    quotas = quotas.withColumn("last", F.floor((F.col("quota") - 1) / F.col("tokens"))).filter("quota > 0")
    spread = rows.join(quotas, "key").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    spread = spread.withColumn("order", _order(target.seed, "e", "epoch")).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    place = ["key", "epoch", "bucket"]
    sums = spread.groupBy(*place).agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("key", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*place, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"))
    running = Window.partitionBy(*place).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("within", F.coalesce(F.sum("n_tokens").over(running), F.lit(0))).join(sums, place)
    placed = spread.withColumn("at", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("within")).filter("at < quota")
    placed = placed.withColumn("block", F.floor(F.col("at") * blocks / F.col("quota")).cast("long"))
    position = F.row_number().over(Window.partitionBy("block").orderBy(_order(target.seed, "b", "epoch"), "doc_id"))
    source = F.when(F.col("key") != "-", F.expr("substring(key, 2)"))
    return placed.select("doc_id", source.alias("source"), "n_tokens", "epoch", "block", position.cast("long").alias("position"))


def _order(seed: int, kind: str, epoch: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{kind}"), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixed_documents(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents in the columns of ``docs``, each as often as the mix has it, in the order of blocks and places.

    Rows that share identifier and source share places. Partitions hold whole blocks one
    after another, so what is written from here is read block by block.
    """
    own = [F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"), "epoch"]
    places = mix(docs, target, id_col, text_col, source_col).groupBy(*own).agg(F.min(F.struct("block", "position")).alias("place"))
    # The columns of the documents travel as one, so that no name of theirs meets one of ours.
    whole = docs.filter(F.col(text_col).rlike(WORD)).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"))
    joined = whole.join(places, F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")))
    placed = joined.select("whole", "place.block", "place.position").repartitionByRange("block").sortWithinPartitions("block", "position")
    return placed.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def oracle(target: Target = Target()) -> str:
    """DuckDB SQL for mix() over documents, for a budget of "corpus" or a number."""
    budget = "(SELECT total FROM t)" if target.budget == "corpus" else str(target.budget)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS MATERIALIZED (SELECT key, sum(n_tokens)::BIGINT AS tokens FROM d WHERE n_tokens > 0 GROUP BY key),
t AS MATERIALIZED (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM s),
b(i, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT i + 1, CASE WHEN flat THEN greatest(m, low) ELSE low END, CASE WHEN flat THEN high ELSE least(m, high) END
    FROM (SELECT i, low, high, m, (
              SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) > {target.entropy} * ln(any_value(n)) OR max(p / tokens) / sum(p) * {budget} > {target.repetition}
              FROM (SELECT tokens, n, pow(tokens / total, m) AS p FROM s, t)) AS flat
          FROM (SELECT i, low, high, CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE (low + high) / 2 END AS m FROM b WHERE i < {STEPS + 2}))),
e AS (SELECT round(high, 9) AS x FROM b ORDER BY i DESC LIMIT 1),
q AS (SELECT key, tokens, round(pow(tokens / total, x) / (SELECT sum(pow(tokens / total, x)) FROM s, t, e) * {budget})::BIGINT AS quota FROM s, t, e),
r AS (SELECT doc_id, key, n_tokens, tokens, quota, unnest(range(0, (quota - 1) // tokens + 1)) AS epoch FROM d JOIN q USING (key) WHERE n_tokens > 0 AND quota > 0),
p AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY key, epoch ORDER BY md5('{target.seed}e:' || epoch || ':' || doc_id), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed_at FROM r),
k AS (SELECT *, floor(placed_at * greatest(1, ceil({budget} / {target.block_tokens})) / quota)::BIGINT AS block FROM p WHERE placed_at < quota)
SELECT doc_id, CASE WHEN key <> '-' THEN substr(key, 2) END AS source, n_tokens, epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('{target.seed}b:' || epoch || ':' || doc_id), doc_id) AS position FROM k
"""
