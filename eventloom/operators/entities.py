"""Entities: rows that share a key are one; their fields are fused, with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import names
from eventloom.operators.storage import global_rank, written

#: Hosts that many firms share, so that their domain says nothing.
AGGREGATORS = ("angellist.com", "angel.co", "linkedin.com", "crunchbase.com", "medium.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "swfinstitute.org", "pitchbook.com")


def entity_keys(rows: DataFrame) -> DataFrame:
    """(row, key): everything by which a source row is known; rows that share a key are the same entity.

    rows: row, source, wikidata_qid, domain, normalized_name, location_state (array), findfunding_slug, manual_seed_slug.
    """
    key = lambda kind, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{kind}:"), value))
    domain = F.when(~F.col("domain").isin(*AGGREGATORS) & (F.col("source") != "url_verify"), F.col("domain"))
    named = F.transform(F.coalesce("location_state", F.array().cast("array<string>")), lambda s: key("name", F.concat(F.nullif(F.col("normalized_name"), F.lit("")), F.lit("|"), s)))
    single = F.array(key("qid", F.col("wikidata_qid")), key("domain", domain), key("findfunding", F.col("findfunding_slug")), key("seed", F.col("manual_seed_slug")))
    return rows.select("row", F.explode(F.array_compact(F.concat(single, named))).alias("key")).distinct()


def components(keys: DataFrame) -> DataFrame:
    """(row, component): the smallest row that shared keys reach.

    Each round takes the least label of a key's rows, then the label of the label; rounds
    are written to the shared folder. A key of very many rows costs one sum per task.
    """
    keys = written(keys)
    label = written(keys.select("row", F.col("row").alias("component")).distinct())
    while True:
        of_key = keys.join(label, "row").groupBy("key").agg(F.min("component").alias("least"))
        near = keys.join(of_key, "key").groupBy("row").agg(F.min("least").alias("near"))
        step = label.join(near, "row").select("row", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        jump = label.select(F.col("row").alias("mid"), F.col("component").alias("far"))
        after = written(step.join(jump, "mid", "left").select("row", "was", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        label = after.select("row", "component")
        if after.filter("was <> component").isEmpty():
            return label


def fuse(rows: DataFrame, lists: list[str], scalars: list[str], by: str = "component") -> DataFrame:
    """One row per entity: lists united in the order they were first seen; of scalars the most trusted, the preferred
    source and the earliest row decide, in that order; and the sources.

    rows: component, row, source, priority, confidence, and the fields.
    """
    aggs = [F.min("row").alias("first_row"), F.array_sort(F.collect_set("source")).alias("source_set")]
    for c in lists:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))
        aggs.append(F.array_distinct(F.flatten(ordered)).alias(c))
    for c in scalars:
        known = F.col(c).isNotNull()
        aggs.append(F.max_by(F.when(known, F.col(c)), F.when(known, F.struct(F.col("confidence"), -F.col("priority"), -F.col("row")))).alias(c))
    return rows.groupBy(by).agg(*aggs)


def provenance(rows: DataFrame, fields: list[str], by: str = "component") -> DataFrame:
    """Long form: entity, field, value, source, confidence for every value that isn't empty."""
    value = lambda c: F.to_json(F.col(c)) if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in fields]))
    out = rows.select(by, "row", "source", "confidence", stacked.alias("p")).select(by, "row", "source", "confidence", "p.field", "p.value")
    return out.filter(F.col("value").isNotNull() & ~F.col("value").isin("", "[]"))


def dedup_companies(edges: DataFrame) -> DataFrame:
    """Companies of the portfolio edges: by key the first spelling, how many edges, and a number in the order of first sight.

    edges: key, name, row.
    """
    grouped = edges.groupBy("key").agg(F.min_by("name", "row").alias("company_canonical_name"), F.count(F.lit(1)).alias("edge_count"), F.min("row").alias("first_row"))
    return global_rank(grouped, "number", F.col("first_row"))


def build_companies(edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Companies of portfolio edges: key, first spelling and normalized name, cusip, edge_count, number in the order of first sight, company_id.

    Edges without a normalized name of two characters or more, and those of scraped garbage,
    are left out. A name of the alias table takes its canonical name's place.
    edges: row, company_name_raw, company_normalized_name, metadata_json (may be missing);
    aliases: alias, canonical (a dimension of manual entries, small by its nature).
    """
    norm, raw = F.col("company_normalized_name"), F.col("company_name_raw")
    rows = edges.filter(F.length(norm) >= 2).withColumn("key", names.normalize_company_name(norm)).filter("key <> ''")
    rows = rows.filter(~F.coalesce(names.is_garbage(raw, F.col("key")), F.lit(False)))
    if aliases is not None:
        listed = aliases.select(names.dedup_key(F.col("alias")).alias("_k"), F.col("canonical").alias("_c")).dropDuplicates(["_k"])
        canonical = names.squeeze(F.regexp_replace(F.lower("_c"), rf"[^{names.WORD}{names.SPACE}]", ""))
        rows = rows.join(listed, names.dedup_key(raw) == F.col("_k"), "left").withColumns({"key": F.when(F.col("_c").isNotNull(), names.normalize_company_name(canonical)).otherwise(F.col("key")), "company_name_raw": F.coalesce("_c", raw)})
    cusip = F.get_json_object("metadata_json", "$.cusip") if "metadata_json" in edges.columns else F.lit(None).cast("string")
    first = F.min_by(F.struct("company_name_raw", "company_normalized_name", cusip.alias("cusip")), "row")
    grouped = rows.groupBy("key").agg(first.alias("f"), F.count(F.lit(1)).alias("edge_count"), F.min("row").alias("first_row"))
    numbered = global_rank(grouped, "number", F.col("first_row"))
    return numbered.select("key", F.col("f.company_name_raw").alias("company_canonical_name"), F.col("f.company_normalized_name").alias("company_normalized_name"), "f.cusip", "edge_count", "number", names.company_id(F.col("number"), names.ascii_slug(F.col("key"))).alias("company_id"))


def conflicting(provenance_rows: DataFrame, field: str, by: str = "component") -> DataFrame:
    """Entities whose sources disagree in a field."""
    values = provenance_rows.filter(F.col("field") == field).groupBy(by).agg(F.count_distinct("value").alias("n_values"))
    return values.filter("n_values > 1")
