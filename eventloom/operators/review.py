"""Review of candidate patterns: removal by policy, one representative for each mask, feature tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.functions import names
from eventloom.operators import context
from eventloom.operators.chains import signature
from eventloom.operators.storage import written
from eventloom.plans import rules

#: Reasons of removal in the order they are tested, and words that mark a field about data quality.
REASONS = ("exit_event", "event_type_other", "outcome_type", "round_unknown_or_other", "end_relative_timing", "duration", "future_only", "nullness_test", "data_quality_basis_or_known_date", "not_human_readable")
QUALITY_WORDS = ("quality", "basis", "known_date", "date_known", "date_precision", "window_status")


class ResourceBound(RuntimeError):
    """A count is over its bound: the result would be incomplete, so there is none."""


def bounded(n: int, most: int, what: str) -> int:
    if n > most:
        raise ResourceBound(f"INCOMPLETE_RESOURCE_BOUND: {n} {what}, {most} allowed")
    return n


#: A rule that is nested deeper is an error.
DEEPEST = 24


def _children(node: Column) -> Column:
    """The values of an object, or the elements of an array."""
    return F.coalesce(F.map_values(F.try_variant_get(node, "$", "map<string,variant>")), F.try_variant_get(node, "$", "array<variant>"), F.array().cast("array<variant>"))


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def nodes(rule: Column) -> Column:
    """All objects inside a rule's JSON text, itself first, as an array of variants: one level of the tree after the other."""
    root = F.array(F.try_parse_json(rule))

    def deeper(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["front"], _children))
        found = F.struct(below.alias("front"), F.concat(acc["seen"], F.filter(acc["front"], _is_object)).alias("seen"))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(found)

    too_deep = F.raise_error(F.lit(f"a rule is nested deeper than {DEEPEST}")).cast("array<variant>")
    none = F.array().cast("array<variant>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), F.struct(root.alias("front"), none.alias("seen")), deeper, lambda acc: F.when(F.size(acc["front"]) > 0, too_deep).otherwise(acc["seen"]))


def _texts(node: Column, path: str) -> Column:
    """The strings at a path, of a list or a scalar, in lower case."""
    several = F.transform(F.try_variant_get(node, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.transform(F.coalesce(several, F.array(F.try_variant_get(node, path, "string"))), lambda x: F.lower(F.trim(x)))


def _facts(texts: DataFrame) -> DataFrame:
    """For each rule, what it says whatever its pair: its objects (null: not sound) and the tests of REASONS on them. texts: rule."""
    text = lambda x, path: F.try_variant_get(x, path, "string")
    some = lambda test: F.coalesce(F.exists("_nodes", test), F.lit(False))
    event_type = lambda kind: some(lambda x: (text(x, "$.field") == "event.event_type") & F.array_contains(_texts(x, "$.value"), kind))
    round_test = lambda x: (text(x, "$.op") == "compare") & (text(x, "$.left.field") == "derived.outcome_round_bucket")
    field = lambda test: F.coalesce(F.exists("_fields", test), F.lit(False))
    tests = {
        "exit_event": event_type("exit"),
        "event_type_other": event_type("other"),
        "outcome_type": field(lambda f: f.contains("outcome_type")),
        "round_unknown_or_other": some(lambda x: round_test(x) & F.arrays_overlap(_texts(x, "$.right.literal"), F.array(F.lit("unknown"), F.lit("other")))),
        "end_relative_timing": some(lambda x: text(x, "$.relative_to") == "end"),
        "duration": field(lambda f: f == "derived.chain_duration_days"),
        "future_only": field(lambda f: f == "derived.company_chain_count"),
        "nullness_test": some(lambda x: (text(x, "$.op") == "compare") & text(x, "$.cmp").isin("is_null", "not_null")),
        "data_quality_basis_or_known_date": field(lambda f: reduce(lambda a, b: a | b, [F.lower(f).contains(w) for w in QUALITY_WORDS])),
    }
    names = F.filter(F.concat(F.transform("_nodes", lambda x: text(x, "$.field")), F.flatten(F.transform("_nodes", lambda x: F.coalesce(F.try_variant_get(x, "$.same_values", "array<string>"), F.array().cast("array<string>"))))), lambda f: f.isNotNull())
    rows = texts.withColumn("_nodes", nodes(F.col("rule"))).withColumn("_fields", names)
    sound = F.coalesce(_is_object(F.try_parse_json("rule")), F.lit(False))
    return rows.select("rule", F.when(sound, F.size("_nodes")).alias("_objects"), *[test.alias(f"_{name}") for name, test in tests.items()])


def reviewed(pairs: DataFrame) -> DataFrame:
    """Adds reason, the first of REASONS to remove a pair (null: kept), and complexity, the objects in its rule; statistics play no part.

    pairs: rule (JSON text), taints (array of texts), event_dimension and structural_dimension with those
    of its components (anchor_dimension, component_dimension). Each different rule is flattened once, by
    functions of variants, and its facts are joined to its pairs: in place if they are small, else by
    the rule. A rule that is null, no JSON or no object is not readable by people.
    """
    facts = written(_facts(pairs.select("rule").filter(F.col("rule").isNotNull()).distinct()))
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    of_pair = {
        "duration": F.coalesce(F.col("structural_dimension") == "duration", F.lit(False)),
        "future_only": F.coalesce(F.array_contains("taints", "future"), F.lit(False)),
        "not_human_readable": differ("event_dimension", "anchor_dimension") | differ("structural_dimension", "component_dimension"),
    }
    tests = {name: reduce(lambda a, b: a | b, [*([F.col(f"_{name}")] if f"_{name}" in facts.columns else []), *([of_pair[name]] if name in of_pair else [])]) for name in REASONS}
    reason = reduce(lambda rest, name: F.when(tests[name], name).otherwise(rest), reversed(REASONS), F.lit(None).cast("string"))
    rows = pairs.join(facts, "rule", "left").withColumns({"reason": F.when(F.col("_objects").isNotNull(), reason).otherwise("not_human_readable"), "complexity": F.col("_objects")})
    return rows.select(*pairs.columns, "reason", "complexity")


@F.pandas_udf(StringType())
def rendered(rule: pd.Series) -> pd.Series:
    """The rule in English; null where it isn't sound."""

    def one(text):
        try:
            return rules.render(rules.parse(text))
        except (TypeError, ValueError):
            return None

    return rule.map(one)


def catalog(pairs: DataFrame) -> DataFrame:
    """Pairs with their reason (null: kept), rendering and what orders representatives.

    pairs: atom, track, and what reviewed() takes; the rules in canonical form.
    """
    rows = reviewed(pairs).withColumn("rendered", F.when(F.col("reason").isNull(), rendered("rule")))
    reason = F.coalesce("reason", F.when(F.col("rendered").isNull(), "not_human_readable"))
    return rows.select("atom", "track", reason.alias("reason"), "rendered", "complexity", F.size(F.split("rendered", r"\s+")).alias("n_words"), F.length("rendered").alias("n_chars"), F.col("rule").alias("canonical"))


def representatives(catalog_rows: DataFrame, masks: DataFrame) -> DataFrame:
    """One kept pair for each track and company mask: least complex, fewest words, shortest, first canonical form, first identifier."""
    kept = catalog_rows.filter(F.col("reason").isNull()).join(masks, "atom")
    order = F.struct("complexity", "n_words", "n_chars", "canonical", "atom")
    best = kept.groupBy("track", "mask").agg(F.min_by(F.struct("atom", "rendered"), order).alias("r"), F.count(F.lit(1)).alias("n_members"))
    return best.select("track", "mask", "r.atom", "r.rendered", "n_members")


def inconsistent(kept: DataFrame) -> DataFrame:
    """Groups of one mask whose members have different results or tables: there should be none. kept: track, mask, result, s1, n1, s0, n0."""
    return kept.groupBy("track", "mask").agg(F.count_distinct("result", "s1", "n1", "s0", "n0").alias("n")).filter("n > 1")


def features(contexts: DataFrame, patterns: dict) -> DataFrame:
    """One row per chain: identity, counts, order status, signature, derived fields, the patterns' flags and the primary one."""
    text = signature(F.array_sort(F.transform(F.filter("events", lambda e: e["batch"].isNotNull()), lambda e: F.struct(e["batch"].alias("batch"), e["family"].alias("family"), e["event_type"].alias("event_type"), e["event_id"].alias("event_id")))))
    status = context.order_status(F.col("chain.chain_window_status"), F.col("events"))
    derived = [F.col(f"derived.{f}").alias(f) for f in contexts.schema["derived"].dataType.fieldNames()]
    keys = [F.col(f"chain.{c}").alias(c) for c in ("chain_id", "company_id", "chain_sequence", "outcome_type")]
    rows = contexts.select(*keys, status.alias("order_status"), text.alias("signature"), *derived, *rules.flags(patterns))
    return rows.withColumn("primary_seed", rules.primary(patterns))


def primary_profiles(flagged: DataFrame, patterns: dict) -> DataFrame:
    """Per company: chains, and for each pattern how many chains have it, whether any does, and the same as primary."""
    aggs = [F.count(F.lit(1)).alias("n_chains")]
    for p in patterns["patterns"]:
        first = F.col("primary_seed") == p["id"]
        aggs += [F.count_if(p["id"]).alias(f"{p['id']}_count"), F.bool_or(p["id"]).alias(f"{p['id']}_any"), F.count_if(first).alias(f"{p['id']}_primary_count"), F.bool_or(first).alias(f"{p['id']}_primary_any")]
    return flagged.groupBy("company_id").agg(*aggs)


def apply_aliases(companies: DataFrame, aliases: DataFrame, name_col: str = "name") -> DataFrame:
    """Names of a manual alias table give way to their canonical name, whatever their case and spaces. aliases: alias, canonical."""
    a = aliases.select(names.dedup_key(F.col("alias")).alias("_k"), F.col("canonical").alias("_c"))
    a = a.unionByName(aliases.select(names.dedup_key(F.col("canonical")).alias("_k"), F.col("canonical").alias("_c"))).groupBy("_k").agg(F.min("_c").alias("_c"))
    joined = companies.join(a, names.dedup_key(F.col(name_col)) == F.col("_k"), "left")
    return joined.withColumn(name_col, F.coalesce("_c", name_col)).drop("_k", "_c")
