"""Freezing candidates before any label is looked at, and evaluating them afterwards.

The frozen publication holds atoms, pairs with their support and masks, and digests of the
inputs and the code that they were made from. It is loaded only if nothing of that has
changed, and labels are joined only then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.operators import bitmaps, lattice, prevalence
from eventloom.operators.generators import Atom, facts_frame
from eventloom.operators.review import bounded
from eventloom.operators.storage import written
from eventloom.plans import rules
from eventloom.sources import sinks

#: The phase that a frozen publication names, tracks, and the bounds beyond which there is no result.
PHASE = "LABEL_BLIND_GENERATION_FREEZE"
ELIGIBLE, DESCRIPTIVE = "ACTION_ELIGIBLE", "DESCRIPTIVE_ASSOCIATION"
MOST_ANCHORS, MOST_STRUCTURAL, MOST_PAIRS = 20_000, 1_000, 250_000
LABELS = ("SUCCESS", "FAILURE")


def _catalog(spark: SparkSession, atoms: list[Atom], role: str) -> DataFrame:
    rows = [(a.name, a.id, role, a.kind, a.dimension, ",".join(a.taints), rules.canonical_json(a.rule)) for a in atoms]
    return spark.createDataFrame(rows, "atom string, id string, role string, kind string, dimension string, taints string, rule string")


def _supported(counts: DataFrame, n_chains: int) -> DataFrame:
    return counts.filter((F.col("n_chains") >= lattice.MIN_CHAINS) & (F.col("n_companies") >= lattice.MIN_COMPANIES) & (F.col("n_chains") < n_chains)).withColumnRenamed("class", "mask")


def _named(spark: SparkSession, counts: DataFrame, names: list[str]) -> DataFrame:
    return counts.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "formula int, atom string")), "formula").drop("formula")


def candidates(contexts: DataFrame, anchors: list[Atom], structural: list[Atom]) -> dict[str, DataFrame]:
    """Tables atoms (with support and masks) and pairs (with track, support and company mask) of supported, compatible candidates.

    Neither an atom nor a pair that holds for every chain says anything; pairs whose facts
    exclude or imply each other are left out before they are counted. ``mask`` tells the set of companies
    apart, of atoms and of pairs; the SHA-256 of the bits of chains and companies are given for atoms.
    """
    spark = contexts.sparkSession
    contexts = bitmaps.numbered(contexts)
    n_chains, n_companies = contexts.agg(F.count(F.lit(1)), F.max("company_no")).first()
    every = {a.name: a.rule for a in anchors + structural}
    masks = written(bitmaps.of_chains(contexts, every))
    counts = _supported(bitmaps.counts(contexts, masks, [((name,), ()) for name in every], "company"), n_chains)
    named = _catalog(spark, anchors, "anchor").unionByName(_catalog(spark, structural, "structural"))
    atoms = written(named.join(_named(spark, counts, list(every)), "atom"))
    counts = dict(atoms.groupBy("role").count().collect())
    bounded(counts.get("anchor", 0), MOST_ANCHORS, "anchors")
    bounded(counts.get("structural", 0), MOST_STRUCTURAL, "structural atoms")
    kept = {r[0] for r in atoms.select("atom").collect()}
    digest = lambda of, size, name: bitmaps.digests(of, size).select("atom", F.col("sha256").alias(name))
    of_companies = bitmaps.of_companies(contexts, {k: r for k, r in every.items() if k in kept})
    atoms = written(atoms.join(digest(masks, n_chains, "chain_mask_sha256"), "atom").join(digest(of_companies, n_companies or 0, "company_mask_sha256"), "atom"))
    left, right = ([a for a in side if a.name in kept] for side in (anchors, structural))
    pairs = spark.createDataFrame([], "anchor string, structural string, n_chains long, n_companies long, mask string")
    if left and right:
        facts = [(r["field"], r["cmp"], r["value"]) for r in facts_frame(spark, right).collect()]
        pairs = _supported(bitmaps.pairs(contexts, masks, [a.name for a in right], lattice.allowed(spark, facts_frame(spark, left), facts), "company"), n_chains)
    side = lambda role: atoms.filter(F.col("role") == role).select(F.col("atom").alias(role), F.col("taints").alias(f"{role}_taints"), F.col("dimension").alias(f"{role}_dimension"))
    tainted = (F.col("anchor_taints") != "") | (F.col("structural_taints") != "")
    pairs = pairs.join(side("anchor"), "anchor").join(side("structural"), "structural").withColumn("track", F.when(tainted, DESCRIPTIVE).otherwise(ELIGIBLE))
    name = F.concat_ws(" & ", "anchor", "structural").alias("atom")
    pairs = written(pairs.select(name, "anchor", "structural", "track", "anchor_dimension", "structural_dimension", "n_chains", "n_companies", "mask"))
    bounded(pairs.count(), MOST_PAIRS, "pairs")
    return {"atoms": atoms, "pairs": pairs}


def freeze(contexts: DataFrame, anchors: list[Atom], structural: list[Atom], inputs: dict[str, DataFrame], path: str, label: str, force: bool = False) -> dict:
    """Publish the candidates with the digests of their inputs; inputs that hold the label are refused."""
    import eventloom.operators.generators
    import eventloom.plans.rules

    seen = [name for name, df in inputs.items() if label in df.columns]
    if seen or label in _names(contexts.schema):
        raise ValueError(f"{label} must not be seen before the freeze ({', '.join(seen) or 'contexts'})")
    code = sinks.code_state(eventloom.operators.generators, eventloom.plans.rules, lattice) | {"phase": PHASE}
    return sinks.publish(contexts.sparkSession, candidates(contexts, anchors, structural), path, force, inputs=inputs, code=code)


def _names(schema: StructType) -> set[str]:
    found = set()
    for f in schema.fields:
        found |= {f.name} | (_names(f.dataType) if isinstance(f.dataType, StructType) else set())
    return found


def load(spark: SparkSession, path: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frozen tables, if they and the inputs are what they were."""
    manifest, tables = sinks.load_published(spark, path)
    if manifest.get("code", {}).get("phase") != PHASE:
        raise ValueError("this is no frozen generation")
    sinks.check_inputs(manifest, inputs)
    return tables


def evaluate(tables: dict[str, DataFrame], contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """The action values of every frozen pair: one 2 x 2 table for each track and mask, given to all pairs that share it.

    labels: company_id, label (SUCCESS or FAILURE), one for each company. A label is one more mask over the chains, so a table is two counts of
    companies in the packed masks.
    """
    spark = contexts.sparkSession
    pairs = tables["pairs"]
    one = written(pairs.groupBy("track", "mask").agg(F.min(F.struct("atom", "anchor", "structural")).alias("r")).select("track", "mask", "r.*"))
    chosen = one.select(F.explode(F.array("anchor", "structural")).alias("atom")).distinct()
    atoms = {r["atom"]: rules.parse(r["rule"]) for r in tables["atoms"].join(chosen, "atom", "left_semi").select("atom", "rule").collect()}  # MOST_ANCHORS and MOST_STRUCTURAL at most
    known = labels.filter(F.col("label").isin(*LABELS)).select(F.col("company_id").alias("_company"), F.col("label").alias("_label"))
    contexts = bitmaps.numbered(contexts.join(known, F.col("chain.company_id") == F.col("_company"), "left").drop("_company"))
    masks = written(bitmaps.of_chains(contexts, atoms).unionByName(bitmaps.of_columns(contexts, {label: F.col("_label") == label for label in LABELS})))
    asked = [(r["atom"], label, r["anchor"], r["structural"]) for r in one.collect() for label in LABELS]  # MOST_PAIRS at most, twice
    found = bitmaps.counts(contexts, masks, [((anchor, structural, label), ()) for _, label, anchor, structural in asked])
    by_label = spark.createDataFrame([(k, atom, label) for k, (atom, label, *_) in enumerate(asked)], "formula int, atom string, label string").join(found, "formula", "left")
    total = known.agg(*[F.count_if(F.col("_label") == label).alias(label) for label in LABELS])
    taking = by_label.groupBy("atom").agg(*[F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n_companies"))), F.lit(0)).alias(f"{label.lower()}_taking") for label in LABELS])
    table = taking.crossJoin(F.broadcast(total))  # a single row
    table = table.select(F.col("atom").alias("pattern"), *[f"{label.lower()}_taking" for label in LABELS], *[(F.col(label) - F.col(f"{label.lower()}_taking")).alias(f"{label.lower()}_not_taking") for label in LABELS])
    values = prevalence.action_values(table).withColumnRenamed("pattern", "representative")
    return pairs.join(one.select("track", "mask", F.col("atom").alias("representative")), ["track", "mask"]).join(values, "representative")


def coverage(tables: dict[str, DataFrame], contexts: DataFrame, references: dict[str, dict]) -> DataFrame:
    """For each reference rule: its companies, and whether some frozen pair or atom has the very same ones (same mask)."""
    spark = contexts.sparkSession
    contexts = bitmaps.numbered(contexts)
    found = bitmaps.counts(contexts, bitmaps.of_chains(contexts, references), [((name,), ()) for name in references], "company")
    wanted = _named(spark, found, list(references)).withColumnsRenamed({"atom": "reference", "class": "mask"})
    known = tables["pairs"].select("mask", "atom").unionByName(tables["atoms"].select("mask", "atom")).groupBy("mask").agg(F.min("atom").alias("covered_by"))
    return wanted.join(known, "mask", "left").select("reference", "n_companies", "covered_by", F.col("covered_by").isNotNull().alias("covered"))
