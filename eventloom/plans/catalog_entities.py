"""Queries on names, entities, identity, evaluation, leakage, sources and checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventloom.functions import names, outcomes, stats
from eventloom.operators import checks, edges, entities, evaluation, identity, leakage
from eventloom.plans import analogues as a
from eventloom.plans.catalog_chains import _MIDDLE
from eventloom.sources import html, readers


def normalize_name(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, " Capital, Partners LLC").when(F.col("p_partkey") % 3 == 1, "-Works & Co.").otherwise(" Ventures  (Fund) Éclair"))
    return rows.select("p_partkey", names.normalize_name(raw).alias("name"), names.normalize_company_name(F.concat(raw, F.lit(" Holdings Inc."))).alias("company"), names.exact_name(raw).alias("exact"), names.dedup_key(raw).alias("dedup"))


def extract_domain(spark, sf_dir):
    rows = a.table(spark, sf_dir, "pages")
    n = F.col("page_id") % 4
    raw = F.when(n == 0, F.regexp_replace("url", "^http://", "HTTP://WWW.")).when(n == 1, F.regexp_replace("url", "^http://", "")).when(n == 2, F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/"))).otherwise(F.col("url"))
    return rows.select("page_id", names.normalize_website(raw).alias("website"), names.extract_domain(names.normalize_website(raw)).alias("domain"), names.name_from_logo(F.concat("url", F.lit(""))).alias("from_logo"), names.is_url(raw).alias("is_url"))


def make_slug_ascii(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part")
    return rows.select("p_partkey", names.ascii_slug(F.concat(F.lit("  "), "p_name", F.lit(" & _"), "p_brand", F.lit("!"))).alias("slug"), names.company_id(F.col("p_partkey") * 7, names.ascii_slug(F.col("p_name"))).alias("company_id"))


def make_slug_unicode(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", names.slug("text").alias("slug"))


def round_bucket(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders")
    kinds = ["Series A", "serie b 2", "Seed Round", "PRE-SEED", "Bridge  Financing", "n/a", "convertible note", "Series", "Venture_Debt", " ", "growth", "Series C extension"]
    raw = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % len(kinds) + 1).cast("int"))
    stages = F.array(F.lower(raw), F.lit("Series A"), F.lit("Any Stage"), F.lit("what"))
    return rows.select("o_orderkey", names.round_bucket(raw).alias("bucket"), names.normalize_stage(raw).alias("stage"), F.array_join(names.normalize_stages(stages), ",").alias("stages"))


def garbage_names(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part")
    kinds = ["Read More", "Acme Founded2010", "2010", "x", "AcquiredShape", "Name: 1 dtype", "Real time customer intelligence at scale for everyone", "Good Name", "Status A"]
    raw = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return rows.select("p_partkey", names.is_garbage(raw, names.normalize_company_name(raw)).alias("garbage"))


def queries_template(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer")
    market = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    text = names.fill_template("{{target_market}} market size {{year}} for {{who}}", {"target_market": market, "year": F.col("c_nationkey")})
    return rows.select("c_custkey", text.alias("query"), text.contains("<null:").alias("unresolved"))


def outcome_labels(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(n / k) % len(xs) + 1).cast("int"))
    label = outcomes.outcome_label(pick(1, "active", "closed", "", "active"), pick(3, "private", "", "public", "private", "delisted", ""), pick(2, "seed", "series_b", "", "series_a", "angel"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(n % 4 == 0, "2021-05-01"), pick(5, "", "it was acquired by x", "has been acquiring", "", "", ""))
    cell = outcomes.evaluation_cell(pick(7, "PASS", "WARN", "FAIL", "other"), label)
    return rows.select("o_orderkey", label.alias("label"), outcomes.truth_class(label).alias("truth"), cell.alias("cell"))


def confusion_f05(spark, sf_dir):
    rows = a.table(spark, sf_dir, "labels")
    passed, good = F.col("toxic") == 0, F.col("quality") == 1
    cell = F.when(F.col("quality").isNull(), "FILTER_truth_ambig").when(passed & good, "TP").when(passed, "FP").when(good, "FN").otherwise("TN")
    return evaluation.confusion(rows.withColumn("cell", cell))


def cohort_funnel(spark, sf_dir):
    rows = a.table(spark, sf_dir, "part")
    path = outcomes.cohort_path(F.concat_ws(" , ", "p_type", "p_brand"), F.col("p_name"), ("ECONOMY", "Brand#1"), "small|red")
    made = rows.select("p_partkey", path.isNotNull().alias("tier1"), outcomes.founded_between(F.concat((F.col("p_size") + 2000).cast("string"), F.lit("-01"))).alias("tier3"))
    return evaluation.funnel(made, "tier1", "tier3")


def stratified_quota(spark, sf_dir):
    return evaluation.quotas(a.table(spark, sf_dir, "orders"), "o_orderpriority", 1000)


def stratified_sample(spark, sf_dir):
    return evaluation.stratified(a.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 20, 7)


def anti_holdout(spark, sf_dir):
    rows = a.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return evaluation.leftover(rows, evaluation.stratified(rows, "c_mktsegment", "c_custkey", 20, 7), "c_custkey")


def score_aggregate(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders")
    verdict = lambda k: F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), (F.floor(F.col("o_orderkey") / k) % 3 + 1).cast("int"))
    score = stats.aggregate_score(verdict(1), verdict(3))
    market, moat = F.round(stats.market_score(F.col("o_totalprice") * 1000), 9), stats.moat_score((F.col("o_orderkey") % 6).cast("double"))
    return rows.select("o_orderkey", score.alias("score"), stats.aggregate_verdict(score).alias("verdict"), stats.dominant_driver(verdict(1), verdict(3)).alias("driver"), market.alias("market"), moat.alias("moat"))


#: A phrase for each built-in pattern, in the order of the families, for cards to be made of.
LEAKS = (
    "NYSE: ABC", "(ABC: XYZ1)", "listed on the NASDAQ", "publicly traded", "IPO in 2015", "market cap of $5", "share price of $5", "trading at $5", "**Public/private**: `public`",
    "acquired by Acme", "acquired for $5", "takeover by Acme", "was acquired", "has been acquired", "got acquired", "was purchased by Acme", "purchased by Acme", "bought by Acme", "merged with Acme", "merger of Acme",
    "wholly owned subsidiary of", "now owned by Acme", "now known as Acme", "now operates as Acme", "formerly known as Acme", "rebranded to Acme", "merging into Acme",
    "ceased operations", "no longer active", "defunct", "domain for sale", "premium domain", "acquisitions@acme", "Sedo", "went out of business", "ceased to exist", "startup failed", "shut its doors", "pivoted off",
    "this domain is for sale", "available for purchase", "website is down", "404 error", "dead link",
    "Series C", "raised $5M in", "$5 million raised", "unicorn status", "$2 billion valuation", "post-money valuation", "post-Series B", "exited at $", "exit of $5", "IPO'd at $", "valuation of $5 million",
    "already realized", "observed before the acquisition", "has wound down", "was not standalone-defensible", "apparent business discontinuity", "terminal to this candidate", "historically successful", "exited via acquisition", "has since become", "currently trading on", "recent closure",
)


def _cards(spark, sf_dir):
    """Candidate cards around whole documents, each with a leak or two: one of LEAKS in the proposal, another in the sections."""
    rows = a.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k, phrases = F.col("doc_id"), F.array(*map(F.lit, LEAKS))
    leak = lambda n: F.element_at(phrases, (n % len(LEAKS) + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("private", "public", "Delisted", "unclear"))), (F.floor(k / 3) % 4 + 1).cast("int"))
    text = F.concat(
        F.lit("# Card\n**Public/private**: "), status, F.lit("\n"),
        F.when(k % 5 == 0, F.concat(F.lit("Founded "), (k % 20 + 2000).cast("string"), F.lit("-05-01\n"))).otherwise(F.concat(F.lit("**Founding year**: `"), (k % 20 + 2000).cast("string"), F.lit("`\n"))),
        F.lit("**Original proposal description**: We plan a tool. "), F.when(k % 2 == 0, leak(F.floor(k / 2))).otherwise("Nothing else"), F.lit(" since "), (k % 30 + 1995).cast("string"), F.lit(".\n**Slug**: s\n\n---\n\n## 1. Revenue model\n"),
        F.when(k % 3 == 0, leak(k)).otherwise("Plain"), F.lit(".\n"), F.col("text"),
    )
    return rows.select(k.alias("card_id"), text.alias("text"))


def leakage_severity(spark, sf_dir):
    """The scan of whole cards: header fields, late years, families in the proposal, retrospective language in the sections."""
    found = leakage.scan(_cards(spark, sf_dir))
    return found.withColumn("post_founding_years", F.array_join(F.col("post_founding_years").cast("array<string>"), ","))


def leakage_hits(spark, sf_dir):
    """All built-in patterns over whole cards, in long form."""
    return leakage.hits(_cards(spark, sf_dir), "card_id", "text").groupBy("family", "pattern").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("matches")).alias("n_matches"))


def leakage_totals(spark, sf_dir):
    scanned = leakage.scan(_cards(spark, sf_dir)).withColumnRenamed("card_id", "doc_id").join(a.table(spark, sf_dir, "labels"), "doc_id")
    return scanned.groupBy("quality").pivot("severity", ["HIGH", "MED", "LOW"]).agg(F.count(F.lit(1))).na.fill(0)


def _sources(spark, sf_dir):
    """Customers and suppliers as source rows of one entity table; keys repeat across them."""
    c = a.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.lit("seed").alias("source"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("v"))
    s = a.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("row"), F.lit("wikidata").alias("source"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("v"))
    rows, k = c.unionByName(s), F.col("row")
    return rows.select(
        "row",
        "source",
        F.when(F.col("source") == "seed", 2).otherwise(1).alias("priority"),
        F.when(k % 9 == 0, F.concat(F.lit("Q"), (F.floor(k / 27) % 40).cast("string"))).alias("wikidata_qid"),
        F.when(k % 7 == 0, "linkedin.com").when(k % 5 == 0, F.concat(F.lit("d"), (k % 31).cast("string"), F.lit(".com"))).alias("domain"),
        F.concat(F.lit("n"), (k % 301).cast("string")).alias("normalized_name"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("S"), F.col("n").cast("string")))).alias("location_state"),
        F.lit(None).cast("string").alias("findfunding_slug"),
        F.lit(None).cast("string").alias("manual_seed_slug"),
        F.when(k % 3 > 0, F.round("v", 0).cast("int")).alias("founded_year"),
        (k % 10 / 10).alias("confidence"),
    )


def entity_components(spark, sf_dir):
    return entities.components(entities.entity_keys(_sources(spark, sf_dir)))


def _fused(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    found = entities.components(entities.entity_keys(rows))
    return rows.join(found, "row", "left").withColumn("component", F.coalesce("component", "row"))


def canonical_fusion(spark, sf_dir):
    made = entities.fuse(_fused(spark, sf_dir), ["location_state"], ["founded_year", "domain"])
    return made.select("component", "first_row", F.array_join("source_set", ",").alias("source_set"), F.array_join("location_state", ",").alias("location_state"), "founded_year", "domain")


def provenance_unpivot(spark, sf_dir):
    return entities.provenance(_fused(spark, sf_dir), ["wikidata_qid", "domain", "founded_year", "location_state"])


def coverage_completeness(spark, sf_dir):
    return provenance_unpivot(spark, sf_dir).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("component").alias("n_entities"))


def conflicting_fields(spark, sf_dir):
    return entities.conflicting(provenance_unpivot(spark, sf_dir), "wikidata_qid")


def company_dedup(spark, sf_dir):
    """Parts as portfolio edges, with scraped garbage, aliases and identifiers of securities among them."""
    k = F.col("p_partkey")
    raw = F.when(k % 9 == 0, "Read More").when(k % 9 == 1, F.concat(F.lit("Alias  "), (k % 5).cast("string"))).otherwise(F.concat(F.initcap("p_name"), F.when(k % 2 == 0, " Inc.").otherwise("")))
    edges_ = a.table(spark, sf_dir, "part").select(k.alias("row"), raw.alias("company_name_raw"), F.when(k % 31 == 0, "x").otherwise(F.lower(names.squeeze(F.regexp_replace(raw, "[.]", "")))).alias("company_normalized_name"), F.when(k % 4 == 0, F.concat(F.lit('{"cusip": "C'), k.cast("string"), F.lit('"}'))).alias("metadata_json"))
    listed = spark.createDataFrame([("ALIAS 1", "Red Widget Corp."), ("alias 2", "Brand-New Company"), ("Red Widget Corp.", "Red Widget Corp.")], "alias string, canonical string")
    return entities.build_companies(edges_, listed).select("key", "company_canonical_name", "company_normalized_name", "cusip", "edge_count", "company_id")


def shared_companies(spark, sf_dir):
    lines = a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count_distinct("l_suppkey").alias("n_investors"), F.count(F.lit(1)).alias("n_edges"))
    return pairs.filter("n_investors >= 2").orderBy(F.col("n_investors").desc(), "o_custkey").limit(20)


def fk_pk_violations(spark, sf_dir):
    lines, orders = a.table(spark, sf_dir, "lineitem"), a.table(spark, sf_dir, "orders")
    pk = checks.duplicate_keys(lines, "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("pk"))
    fk = checks.unknown_keys(lines, "l_orderkey", orders.filter("o_orderstatus <> 'P'"), "o_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("fk"))
    return pk.unionByName(fk)


def _interface(spark, sf_dir):
    n = F.col("event_id")
    return a.table(spark, sf_dir, "events").select(
        n.cast("string").alias("event_id"),
        F.when(n % 3 == 0, F.concat(F.lit("inv"), (n % 20).cast("string"))).alias("investor_id"),
        F.when(n % 5 == 0, " ").when(n % 5 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Supplier "), (n % 30).cast("string"), F.lit(" Capital"))).alias("raw_investor_name"),
    )


def overlay_left_join(spark, sf_dir):
    n = F.col("event_id").cast("long")
    rows = _interface(spark, sf_dir)
    given = rows.filter(n % 4 == 0).select("event_id", F.when(n % 8 == 0, "base").alias("investor_id"), F.when(n % 8 == 4, F.concat(F.lit("ae"), "event_id")).alias("associated_entity_id"), F.when(n % 8 == 0, "canonical_resolved").otherwise("associated_entity").alias("status"))
    return identity.apply_resolutions(rows, given)


def appended_collisions(spark, sf_dir):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    base = a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("i"), s.cast("string")).alias("investor_id"), F.when(s % 2 == 0, F.concat(F.lit("Q"), s.cast("string"))).alias("wikidata_qid"), F.concat(F.lit("Supplier, "), s.cast("string")).alias("name"))
    added = a.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), c.cast("string")).alias("investor_id"), F.when(c % 3 == 0, F.concat(F.lit("Q"), (c * 7 % 1000).cast("string"))).alias("wikidata_qid"), F.concat(F.lit("SUPPLIER "), (c * 3 % 2000).cast("string")).alias("name"))
    return identity.appended_collisions(base, added)


#: What is wrong with the records of overlay_records(), by the remainder of the document's number.
OVERLAY_FAULTS = (
    "", "schema_version is invalid", "the record is of another event", "the source row has another digest", "status is invalid", "a record of nobody has names", "a name's fields don't match the schema",
    "the evidence's fields don't match the schema", "ordinals aren't 1 and on", "a quote or name doesn't stand where it is said to", "a quote or name doesn't stand where it is said to", "",
)


def _faults(upto: int) -> str:
    """The messages in SQL; those from ``upto`` on are about names, and empty where there are none."""
    return ", ".join("'" + ("FAIL: " + m.replace("'", "''") if m and k < upto else "") + "'" for k, m in enumerate(OVERLAY_FAULTS))


def overlay_records(spark, sf_dir):
    """Recovery records of names that stand in a document, broken in known ways; from a title, or from a page where that is as good.

    Texts that are too short for the quote, or null, have a record that names nobody.
    """
    k, named = F.col("doc_id") % len(OVERLAY_FAULTS), F.length("title") >= 80
    rows = a.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.col("text").alias("title"), F.concat(F.lit("int:"), F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 20)).alias("event_id"), F.sha2("text", 256).alias("row_hash"))
    start, name_start, size = 10, 5, 12
    quote = F.substring("title", start + 1, 40)
    name = F.substring(quote, name_start + 1, size)
    page = k == 11
    number = lambda wrong, right, other: F.when(k == wrong, other).otherwise(right)
    evidence = F.struct(
        F.when(page, "source_page").otherwise("title").alias("source_field"), quote.alias("quote"), F.when(page, 0).otherwise(start + F.when(k == 9, 1).otherwise(0)).alias("quote_start"), F.when(page, 40).otherwise(start + 40 + F.when(k == 9, 1).otherwise(0)).alias("quote_end"),
        F.lit(name_start).alias("name_start_in_quote"), number(10, name_start + size, name_start + size + 1).alias("name_end_in_quote"), F.when(page, "http://page").alias("source_url"), F.when(k == 7, 1).alias("more"),
    )
    one = F.struct(number(8, 1, 2).alias("ordinal"), name.alias("raw_investor_name"), evidence.alias("evidence"), F.when(k == 6, "x").alias("more"))
    record = F.struct(
        F.when(k == 1, "v0").otherwise("v1").alias("schema_version"), names.record_id("v1", F.col("event_id"), F.col("row_hash")).alias("record_id"), F.when(k == 2, F.lit("int:" + "0" * 20)).otherwise(F.col("event_id")).alias("source_event_id"),
        F.when(k == 3, F.lit("0" * 64)).otherwise(F.col("row_hash")).alias("source_row_sha256"), F.when(k == 4, "LOST").when((k == 5) | ~named, identity.NOBODY).otherwise(identity.RECOVERED).alias("status"), F.filter(F.array(one), lambda _: named).alias("names"),
    )
    found = identity.overlay_messages(F.to_json(record), "v1", F.col("event_id"), F.col("row_hash"), F.col("title"), F.lit(None).cast("string"), F.lit("http://page"))
    return rows.select("doc_id", F.array_join(found, "|").alias("messages"))


def identity_statuses(spark, sf_dir):
    investors = a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("inv"), F.col("s_suppkey").cast("string")).alias("investor_id"), F.concat(F.lit("supplier "), (F.col("s_suppkey") % 25 + F.when(F.col("s_suppkey") < 10, 0).otherwise(5)).cast("string")).alias("normalized_name"))
    rows = _interface(spark, sf_dir).withColumn("associated_entity_id", F.when(F.col("event_id").cast("long") % 11 == 0, "x"))
    return identity.identity_status(rows, investors).select("event_id", "identity_status", "candidate_id")


def identity_package(spark, sf_dir):
    return identity.package_rows(_interface(spark, sf_dir)).select("raw_investor_name", "n_events", "event_ids_sha256", F.element_at("event_ids", 1).alias("first_event"))


def name_recovery(spark, sf_dir):
    n = F.col("event_id").cast("long")
    rows = _interface(spark, sf_dir)
    two = F.array(F.struct(F.lit(2).alias("ordinal"), F.lit("Beta Fund").alias("raw_investor_name")), F.struct(F.lit(1).alias("ordinal"), F.concat(F.lit("Alpha "), (n % 9).cast("string")).alias("raw_investor_name")))
    overlay = rows.filter(n % 6 == 1).select(F.col("event_id").alias("source_event_id"), two.alias("recovered"))
    return identity.recovered(rows, overlay).select("event_id", "source_event_id", "raw_investor_name")


def unique_key_remap(spark, sf_dir):
    k = F.col("c_custkey")
    legacy = a.table(spark, sf_dir, "customer").select(F.concat(F.lit("L"), k.cast("string")).alias("legacy_id"), F.when(k % 2 == 0, F.concat(F.lit("Q"), (k % 150).cast("string"))).alias("wikidata_qid"), F.concat(F.lit("Supplier-"), (k % 140).cast("string")).alias("name"))
    s = F.col("s_suppkey")
    base = a.table(spark, sf_dir, "supplier").select(s.cast("string").alias("investor_id"), F.concat(F.lit("Q"), (s % 90).cast("string")).alias("wikidata_qid"), F.concat(F.lit("SUPPLIER "), s.cast("string")).alias("name"))
    return identity.legacy_to_base(legacy, base)


def quote_checks(spark, sf_dir):
    rows = a.table(spark, sf_dir, "documents")
    start = F.col("doc_id") % 50
    quote = F.substring("text", (start + 1 + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).cast("int"), F.lit(12))
    return rows.select("doc_id", identity.quote_holds(F.col("text"), quote, start.cast("int"), (start + 12).cast("int")).alias("holds"), identity.row_sha256("source", "lang").alias("row_sha256"))


def coverage_gaps(spark, sf_dir):
    return identity.coverage_gaps(a.table(spark, sf_dir, "documents"), a.table(spark, sf_dir, "labels"), "doc_id")


def html_links(spark, sf_dir):
    """Entries of the navigation list of each page, through the selector reader."""
    return html.extract(a.table(spark, sf_dir, "pages"), "page_id", "html", "nav ul li", {"name": ("a", "text"), "href": ("a", "href")}).select("page_id", "entry", "name", "href")


def newest_partition(spark, sf_dir):
    rows = a.table(spark, sf_dir, "pages")
    made = rows.select(F.regexp_extract("url", "^http://([^/]+)/", 1).alias("slug"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")).alias("day"), "page_id")
    return readers.newest(made, "slug", "day", "page_id").select("slug", F.col("day").alias("newest"), "page_id")


def _edges(spark, sf_dir):
    """Supplier-part pairs as portfolio edges; a pair that was shipped often is listed often."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    row = (k * 100_000 + F.col("l_partkey")) * 10 + n
    return a.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("investor_id"),
        F.concat(F.lit("c"), (F.col("l_partkey") % 50).cast("string")).alias("company_normalized_name"),
        F.when(k % 3 == 0, "Read More").when(k % 3 == 1, "/path").otherwise("Name").alias("company_name_raw"),
        row.alias("row"),
        F.when(n == 1, F.array(F.lit("seed"))).when(n == 2, F.array(F.lit("growth"), F.lit("seed"))).alias("stage_at_investment"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("i"), (k % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("industry"),
        F.when(k % 7 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("company_url"),
        F.when(k % 4 == 0, "active").alias("position"),
    )


def edge_upsert(spark, sf_dir):
    made = edges.upsert(_edges(spark, sf_dir))
    return made.select("investor_id", "company_normalized_name", "row", F.array_join("stage_at_investment", ",").alias("stages"), F.array_join(F.array_sort("industry"), ",").alias("industries"), "company_url", "position")


def edge_coverage(spark, sf_dir):
    return edges.coverage(_edges(spark, sf_dir))


def edge_spot_check(spark, sf_dir):
    return edges.spot_check(_edges(spark, sf_dir))


def selector_self_test(spark, sf_dir):
    return edges.page_checks(html_links(spark, sf_dir), 1, 6)


def chain_contract(spark, sf_dir):
    """Violations of chains, events and companies that are broken on purpose, each kind by a remainder of its own."""
    from eventloom.plans.catalog_patterns import _contract

    made = _contract(spark, sf_dir).withColumn("n", (F.col("company_id") * 31 + F.col("chain_sequence")) % 17)
    n = F.col("n")
    known = {c: F.col(c) for c in made.columns}
    text = lambda k, value, c: F.when(n == k, value).otherwise(known[c])
    swap = lambda here, there: F.when(n == 12, known[there]).otherwise(known[here])
    other = F.transform("exposure_event_ids", lambda x: F.concat(F.lit("gone"), x))
    undated = n.isin(5, 6)
    broken = made.withColumns(
        {
            "company_id": F.when(n == 1, -known["company_id"] - 1).when((n == 13), F.lit(0)).otherwise(known["company_id"]),
            "company_label_v4": text(2, "FAILURE", "company_label_v4"),
            "chain_window_status": F.when(n == 3, "open").when(undated, "unknown_end_date").otherwise(known["chain_window_status"]),
            "chain_end_date": F.when(n == 4, "2024-13-01").when(n == 6, "unknown").otherwise(known["chain_end_date"]),
            "chain_start_date": text(7, "soon", "chain_start_date"),
            "n_participant_rows": F.when(n == 8, F.lit(1)).otherwise(F.lit(0)).cast("long"),
            "n_exposure": F.when(n == 9, known["n_exposure"] + 1).when(n == 12, known["n_interface"]).otherwise(known["n_exposure"]),
            "n_interface": swap("n_interface", "n_exposure"),
            "exposure_event_ids": F.when(n == 11, other).when(n == 12, known["interface_event_ids"]).otherwise(known["exposure_event_ids"]),
            "interface_event_ids": swap("interface_event_ids", "exposure_event_ids"),
            "exposure_types": F.when(n == 14, F.transform("exposure_event_ids", lambda x: F.lit("x"))).when(n == 12, F.transform("interface_event_ids", lambda x: F.lit("x"))).otherwise(F.transform("exposure_event_ids", lambda x: F.lit(None).cast("string"))),
            "interface_types": F.when(n == 12, F.transform("exposure_event_ids", lambda x: F.lit("x"))).otherwise(F.transform("interface_event_ids", lambda x: F.lit(None).cast("string"))),
        }
    )
    # A chain whose event is listed twice, and one that is there twice.
    twice = F.when((n == 10) & (F.size("exposure_event_ids") > 0), F.concat("exposure_event_ids", F.slice("exposure_event_ids", 1, 1)))
    broken = broken.withColumns({"n_exposure": F.when(twice.isNotNull(), F.col("n_exposure") + 1).otherwise(F.col("n_exposure")), "exposure_types": F.when(twice.isNotNull(), F.transform(twice, lambda x: F.lit(None).cast("string"))).otherwise(F.col("exposure_types")), "exposure_event_ids": F.coalesce(twice, "exposure_event_ids")})
    broken = broken.unionByName(broken.filter(n == 15))
    rows = a.events(spark, sf_dir).filter("family <> 'outcome'").select("event_id", "family", "company_id", F.lit(None).cast("string").alias("event_type"))
    stray = rows.filter(F.col("event_id").cast("long") % 50 == 0).select(F.concat(F.lit("stray"), "event_id").alias("event_id"), "family", F.lit(-1).cast("long").alias("company_id"), "event_type")
    companies = a.table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.lit("SUCCESS").alias("label")).distinct()
    companies = companies.unionByName(companies.filter("company_id % 50 = 0"))
    found = checks.chain_violations(broken.withColumn("company_id", F.col("company_id").cast("long")), rows.unionByName(stray), companies)
    return found.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


_TAIL = lambda words: f"(?:(?:^| )(?:{'|'.join(words)}))+$"
_SQUEEZE = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_RAW = "'  ' || p_init || CASE p_partkey % 3 WHEN 0 THEN ' Capital, Partners LLC' WHEN 1 THEN '-Works & Co.' ELSE ' Ventures  (Fund) Éclair' END"
_INIT = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_EDGES = """ed AS (SELECT l_suppkey AS investor_id, 'c' || l_partkey % 50 AS c, l_orderkey AS k, l_linenumber AS n, (l_orderkey * 100000 + l_partkey) * 10 + l_linenumber AS row,
  CASE WHEN l_orderkey % 5 = 0 THEN 'i' || l_orderkey % 3 END AS ind, CASE WHEN l_orderkey % 7 = 0 THEN 'u' || l_orderkey END AS url, CASE WHEN l_orderkey % 4 = 0 THEN 'active' END AS pos FROM lineitem)"""
_IFACE = "ix AS (SELECT event_id::VARCHAR AS event_id, event_id AS n, CASE WHEN event_id % 3 = 0 THEN 'inv' || event_id % 20 END AS investor_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'Supplier ' || event_id % 30 || ' Capital' END AS raw_investor_name FROM events)"
_SRC = """src AS (SELECT *, CASE source WHEN 'seed' THEN 2 ELSE 1 END AS priority, CASE WHEN row % 9 = 0 THEN 'Q' || (row // 27) % 40 END AS qid, CASE WHEN row % 7 = 0 THEN 'linkedin.com' WHEN row % 5 = 0 THEN 'd' || row % 31 || '.com' END AS domain,
    'n' || row % 301 AS nn, CASE WHEN row % 4 = 0 THEN 'S' || n END AS st, CASE WHEN row % 3 > 0 THEN round(v, 0)::INT END AS fy, row % 10 / 10 AS confidence
  FROM (SELECT c_custkey AS row, 'seed' AS source, c_nationkey AS n, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey + 1000000000, 'wikidata', s_nationkey, s_acctbal FROM supplier)),
ky AS (SELECT row, 'q' || qid AS k FROM src WHERE qid IS NOT NULL UNION SELECT row, 'd' || domain FROM src WHERE domain <> 'linkedin.com' UNION SELECT row, 'n' || nn || '|' || st FROM src WHERE st IS NOT NULL),
lk AS (SELECT DISTINCT a.row AS x, b.least AS y FROM ky a JOIN (SELECT k, min(row) AS least FROM ky GROUP BY k) b USING (k)),
ed AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
cc(v, c) AS (SELECT DISTINCT row, row FROM ky UNION SELECT ed.y, cc.c FROM cc JOIN ed ON ed.x = cc.v),
cm AS (SELECT v AS row, min(c) AS component FROM cc GROUP BY v),
fu AS (SELECT src.*, coalesce(component, row) AS component FROM src LEFT JOIN cm USING (row))"""
_PROV = f"""WITH RECURSIVE {_SRC}, pv AS (SELECT component, row, source, confidence, field, value FROM (
    SELECT component, row, source, confidence, 'wikidata_qid' AS field, qid AS value FROM fu UNION ALL SELECT component, row, source, confidence, 'domain', domain FROM fu
    UNION ALL SELECT component, row, source, confidence, 'founded_year', fy::VARCHAR FROM fu UNION ALL SELECT component, row, source, confidence, 'location_state', '["' || st || '"]' FROM fu) WHERE value IS NOT NULL AND value <> '')"""
_TEXT = lambda x: "'" + x.replace("'", "''") + "'"
#: RE2 looks at nothing ahead: the one pattern that does has the rest of its line in the match here.
_PATTERN = lambda p: _TEXT("(?i)" + re.sub(r"\(\?=(.*)\)$", r"\1", p))
_LEAKS = "[" + ", ".join(map(_TEXT, LEAKS)) + "]"
_CARDS = f"""cd AS (SELECT doc_id AS card_id, doc_id % 20 + 2000 AS founded, ['private', 'public', 'delisted', NULL][(doc_id // 3) % 4 + 1] AS field,
    'We plan a tool. ' || CASE WHEN doc_id % 2 = 0 THEN {_LEAKS}[(doc_id // 2) % {len(LEAKS)} + 1] ELSE 'Nothing else' END || ' since ' || (doc_id % 30 + 1995) || '.' AS p, doc_id % 30 + 1995 AS year,
    '---' || chr(10) || chr(10) || '## 1. Revenue model' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN {_LEAKS}[doc_id % {len(LEAKS)} + 1] ELSE 'Plain' END || '.' || chr(10) || coalesce(text, '') AS s,
    '# Card' || chr(10) || '**Public/private**: ' || ['private', 'public', 'Delisted', 'unclear'][(doc_id // 3) % 4 + 1] || chr(10) || '**Original proposal description**: ' || p || chr(10) || '**Slug**: s' || chr(10) || chr(10) || s AS card FROM documents)"""
_ANY = lambda column, family: "(" + " OR ".join(f"regexp_matches({column}, {_PATTERN(p)})" for p in leakage.FAMILIES[family].values()) + ")"
_SCANNED = f"""{_CARDS}, sv AS (SELECT card_id, founded::INT AS founding_year, field AS public_private_field, length(trim(p))::INT AS proposal_desc_length, length(s)::INT AS llm_sections_length,
    CASE WHEN year >= 2000 AND year > founded + 2 THEN year::VARCHAR ELSE '' END || CASE WHEN p LIKE '%2015%' AND 2015 > founded + 2 THEN '' ELSE '' END AS own_year, p, s,
    CASE WHEN field = 'public' THEN 3 ELSE 0 END + {" + ".join(f"CASE WHEN {_ANY('p', f)} THEN {w} ELSE 0 END" for f, w in leakage.WEIGHTS.items())} + CASE WHEN {_ANY('s', 'retrospective')} THEN 1 ELSE 0 END AS base FROM cd),
  ys AS (SELECT *, array_to_string(list_filter(regexp_extract_all(p, '\\b(20[0-9][0-9])\\b', 1), lambda y: y::INT > founding_year + 2), ',') AS years FROM sv),
  sc AS (SELECT card_id, founding_year, public_private_field, proposal_desc_length, llm_sections_length, years AS post_founding_years, base + CASE WHEN years <> '' THEN 1 ELSE 0 END AS severity_score FROM ys),
  lv AS (SELECT *, CASE WHEN severity_score >= 3 THEN 'HIGH' WHEN severity_score >= 1 THEN 'MED' ELSE 'LOW' END AS severity FROM sc)"""
_SCANNED = _SCANNED.replace(" || CASE WHEN p LIKE '%2015%' AND 2015 > founded + 2 THEN '' ELSE '' END", "")
_PICK = lambda k, *xs: f"[{', '.join(repr(x) for x in xs)}][(o_orderkey // {k}) % {len(xs)} + 1]"
_LABELS = f"""lb AS (SELECT o_orderkey, {_PICK(1, 'active', 'closed', '', 'active')} AS op, {_PICK(3, 'private', '', 'public', 'private', 'delisted', '')} AS ipo, {_PICK(2, 'seed', 'series_b', '', 'series_a', 'angel')} AS ft,
    {_PICK(5, '', 'it was acquired by x', 'has been acquiring', '', '', '')} AS g, {_PICK(7, 'PASS', 'WARN', 'FAIL', 'other')} AS verdict, ('2024-08-01'::DATE - o_orderdate::DATE) / 365.25 AS age, CASE WHEN o_orderkey % 4 = 0 THEN ('2024-08-01'::DATE - '2021-05-01'::DATE) / 365.25 END AS last FROM orders),
  lc AS (SELECT *, CASE WHEN ipo = 'public' THEN 'POSITIVE_IPO' WHEN ipo = 'delisted' THEN 'EQUIVOCAL_DELISTED' WHEN g = 'it was acquired by x' THEN 'POSITIVE_ACQUIRED' WHEN op = 'closed' THEN 'NEGATIVE_CLOSED' WHEN op = 'active' AND ft = 'series_b' THEN 'POSITIVE_LATE_STAGE_FUNDED'
    WHEN op = 'active' AND ft IN ('', 'seed', 'angel') AND age >= 5 AND coalesce(last, age) >= 5 THEN 'NEGATIVE_NO_TRACTION' WHEN op = 'active' THEN 'INDETERMINATE' ELSE 'UNKNOWN' END AS label FROM lb),
  lt AS (SELECT *, CASE WHEN label IN ('INDETERMINATE', 'UNKNOWN') THEN 'AMBIG' WHEN label LIKE 'NEGATIVE%' THEN 'FAILURE' ELSE 'SUCCESS' END AS truth FROM lc)"""
_SAMPLE = "sa AS (SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) <= 20)"
_WILSON = lambda p, n, sign: f"(({p} + 3.8416 / (2 * {n})) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n})"
_F = lambda p, r: f"(CASE WHEN {p} = 0 AND {r} = 0 THEN 0.0 ELSE 1.25 * ({p}) * ({r}) / (0.25 * ({p}) + ({r})) END)"


#: Entries of the pages' navigation lists, by pattern.
_LINKS = r"""nv AS (SELECT page_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1) AS nav FROM pages),
  lx AS (SELECT page_id, unnest(x) AS x, unnest(range(0, len(x))) AS entry FROM (SELECT page_id, regexp_extract_all(nav, '(?s)<li>(.*?)</li>', 1) AS x FROM nv)),
  li AS (SELECT page_id, entry::INT AS entry, nullif(trim(replace(regexp_extract(x, '<a[^>]*>(.*?)</a>', 1), '&amp;', '&')), '') AS name, nullif(replace(regexp_extract(x, 'href="([^"]*)"', 1), '&amp;', '&'), '') AS href FROM lx)"""


QUERIES = {
    "normalize_name": (normalize_name, rf"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM (SELECT p_partkey, {_INIT} AS p_init FROM part)),
      c AS (SELECT p_partkey, raw, {_SQUEEZE(r"regexp_replace(lower(raw || ' Holdings Inc.'), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g')")} AS full_company FROM r)
      SELECT p_partkey, regexp_replace({_SQUEEZE(r"regexp_replace(lower(raw), '[^\p{L}\p{M}\p{N}_\s-]', ' ', 'g')")}, '{_TAIL(names.NAME_TAIL)}', '') AS name,
      coalesce(nullif(regexp_replace(full_company, '{_TAIL(names.LEGAL_TAIL)}', ''), ''), full_company) AS company, {_SQUEEZE(r"regexp_replace(lower(raw), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')")} AS exact, lower({_SQUEEZE('raw')}) AS dedup FROM c"""),
    "extract_domain": (extract_domain, r"""WITH r AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^http://', 'HTTP://WWW.') WHEN 1 THEN regexp_replace(url, '^http://', '') WHEN 2 THEN regexp_replace(url, '\?.*$', '') || '/' ELSE url END AS raw FROM pages),
      w AS (SELECT *, CASE WHEN contains(raw, '://') THEN raw ELSE 'https://' || raw END AS u FROM r),
      p AS (SELECT *, lower(regexp_extract(u, '^([^:/?#]*)://', 1)) AS sch, lower(regexp_extract(u, '^[^:/?#]*://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(u, '^[^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(u, '^[^:/?#]*://[^/?#]*[^?#]*(.*)$', 1) AS tail FROM w),
      lg AS (SELECT *, string_split(rtrim(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), '/')[-1] AS stem FROM p)
      SELECT page_id, sch || '://' || host || path || tail AS website, array_to_string(string_split(regexp_replace(host, '^www\.', ''), '.')[-2:], '.') AS domain,
      coalesce(nullif(array_to_string(list_filter(string_split(replace(stem, '_', '-'), '-'), lambda t: t <> '' AND NOT regexp_full_match(t, '(19|20)[0-9]{2}|[a-zA-Z]?[0-9]{6,}|[0-9]+')), '_'), ''), nullif(stem, ''), url) AS from_logo,
      raw LIKE 'http://%' OR raw LIKE 'https://%' OR raw LIKE '/%' AS is_url FROM lg"""),
    "make_slug_ascii": (make_slug_ascii, r"""WITH s AS (SELECT p_partkey, substr(replace(regexp_replace(regexp_replace(regexp_replace(lower('  ' || p_name || ' & _' || p_brand || '!'), '[^0-9a-z_]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '_', '-'), 1, 50) AS slug,
        substr(regexp_replace(lower(p_name), '[^0-9a-z_]+', '-', 'g'), 1, 50) AS short FROM part) SELECT p_partkey, slug, printf('co:%04d-%04d:%s', p_partkey * 7 // 10000, p_partkey * 7 % 10000, short) AS company_id FROM s"""),
    "make_slug_unicode": (make_slug_unicode, r"SELECT doc_id, replace(substr(array_to_string(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+'), '-'), 1, 50), '_', '-') AS slug FROM documents"),
    "round_bucket": (round_bucket, """SELECT o_orderkey, ['series_a', 'series_b', 'seed', 'pre_seed', 'bridge_or_extension', 'unknown', 'convertible', 'series_s', 'debt', 'unknown', 'other', 'bridge_or_extension'][o_orderkey % 12 + 1] AS bucket,
      ['series-a', NULL, NULL, 'pre-seed', NULL, NULL, NULL, NULL, NULL, NULL, 'growth', NULL][o_orderkey % 12 + 1] AS stage, ['series-a,any', 'series-a,any', 'series-a,any', 'pre-seed,series-a,any', 'series-a,any', 'series-a,any', 'series-a,any', 'series-a,any', 'series-a,any', 'series-a,any', 'growth,series-a,any', 'series-a,any'][o_orderkey % 12 + 1] AS stages FROM orders"""),
    "garbage_names": (garbage_names, "SELECT p_partkey, p_partkey % 9 < 7 AS garbage FROM part"),
    "queries_template": (queries_template, "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '<null:target_market>' END || ' market size ' || c_nationkey || ' for <null:who>' AS query, true AS unresolved FROM customer"),
    "outcome_labels": (outcome_labels, f"""WITH {_LABELS} SELECT o_orderkey, label, truth, CASE WHEN verdict = 'other' THEN 'UNEXPECTED' WHEN truth = 'AMBIG' THEN 'FILTER_truth_ambiguous' WHEN truth = 'SUCCESS' THEN CASE WHEN verdict = 'PASS' THEN 'TP' ELSE 'FN' END ELSE CASE WHEN verdict = 'PASS' THEN 'FP' ELSE 'TN' END END AS cell FROM lt"""),
    "confusion_f05": (confusion_f05, f"""WITH c AS (SELECT count(*) FILTER (toxic = 0 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality <> 1) AS fp, count(*) FILTER (toxic <> 0 AND quality <> 1) AS tn, count(*) FILTER (toxic <> 0 AND quality = 1) AS fn, count(*) AS n FROM labels),
      p AS (SELECT *, n - tp - fp - tn - fn AS n_filtered, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
      SELECT *, {_F('precision', 'recall')} AS f05, {_F(f"greatest(0.0, {_WILSON('precision', '(tp + fp)', '-')})", f"greatest(0.0, {_WILSON('recall', '(tp + fn)', '-')})")} AS f05_low, {_F(f"least(1.0, {_WILSON('precision', '(tp + fp)', '+')})", f"least(1.0, {_WILSON('recall', '(tp + fn)', '+')})")} AS f05_high FROM p"""),
    "cohort_funnel": (cohort_funnel, "WITH t AS (SELECT (p_type = 'ECONOMY' OR p_brand = 'Brand#1' OR regexp_matches(p_name, '(?i)small|red')) AS t1, p_size + 2000 BETWEEN 2010 AND 2026 AS t3 FROM part) SELECT count(*) AS n_total, count(*) FILTER (t1) AS n_tier1, count(*) FILTER (t1 AND t3) AS n_tier3 FROM t"),
    "stratified_quota": (stratified_quota, """WITH c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS a FROM orders GROUP BY 1), b AS (SELECT *, (n * 1000 // a)::BIGINT AS base, n * 1000 % a AS rest FROM c),
      r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, o_orderpriority DESC) AS k, 1000 - sum(base) OVER () AS left_ FROM b) SELECT o_orderpriority, n, base + CASE WHEN k <= left_ THEN 1 ELSE 0 END AS quota FROM r"""),
    "stratified_sample": (stratified_sample, f"WITH {_SAMPLE} SELECT * FROM sa"),
    "anti_holdout": (anti_holdout, f"WITH {_SAMPLE} SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN sa USING (c_custkey)"),
    "score_aggregate": (score_aggregate, """WITH v AS (SELECT o_orderkey, o_totalprice * 1000 AS d, ['PASS', 'WARN', 'FAIL'][o_orderkey % 3 + 1] AS m, ['PASS', 'WARN', 'FAIL'][(o_orderkey // 3) % 3 + 1] AS u, o_orderkey % 3 AS a, (o_orderkey // 3) % 3 AS b FROM orders),
      s AS (SELECT *, ((2 - a) / 2.0 + (2 - b) / 2.0)::DOUBLE / 2 AS score FROM v)
      SELECT o_orderkey, score, CASE WHEN score >= 0.5 THEN 'PASS' WHEN score >= 0.25 THEN 'WARN' ELSE 'FAIL' END AS verdict, CASE WHEN b > a THEN 'U' ELSE 'M' END AS driver, round(greatest(0.0, least(1.0, (log10(d) - 7) / 3)), 9) AS market, least(1.0, (o_orderkey % 6)::DOUBLE / 4) AS moat FROM s"""),
    "leakage_severity": (leakage_severity, f"WITH {_SCANNED} SELECT * FROM lv"),
    "leakage_hits": (leakage_hits, f"WITH {_CARDS}, h AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, '{n}' AS pattern, card_id, len(regexp_extract_all(card, {_PATTERN(p)})) AS k FROM cd" for f, ps in leakage.FAMILIES.items() for n, p in ps.items()) + ") SELECT family, pattern, count(*) AS n_docs, sum(k)::BIGINT AS n_matches FROM h WHERE k > 0 GROUP BY ALL"),
    "leakage_totals": (leakage_totals, f"WITH {_SCANNED} SELECT quality, count(*) FILTER (severity = 'HIGH') AS HIGH, count(*) FILTER (severity = 'MED') AS MED, count(*) FILTER (severity = 'LOW') AS LOW FROM lv JOIN labels ON card_id = doc_id GROUP BY quality"),
    "entity_components": (entity_components, f"WITH RECURSIVE {_SRC} SELECT row, component FROM cm"),
    "canonical_fusion": (canonical_fusion, f"""WITH RECURSIVE {_SRC} SELECT component, min(row) AS first_row, string_agg(DISTINCT source, ',' ORDER BY source) AS source_set,
      coalesce(array_to_string(list_distinct_ordered, ','), '') AS location_state, arg_max(fy, (confidence, -priority, -row)) FILTER (fy IS NOT NULL) AS founded_year, arg_max(domain, (confidence, -priority, -row)) FILTER (domain IS NOT NULL) AS domain
      FROM fu JOIN (SELECT component, list(st ORDER BY first) FILTER (st IS NOT NULL) AS list_distinct_ordered FROM (SELECT component, st, min(row) AS first FROM fu GROUP BY ALL) GROUP BY component) USING (component) GROUP BY component, list_distinct_ordered"""),
    "provenance_unpivot": (provenance_unpivot, f"{_PROV} SELECT * FROM pv"),
    "coverage_completeness": (coverage_completeness, f"{_PROV} SELECT field, source, count(*) AS n_values, count(DISTINCT component) AS n_entities FROM pv GROUP BY ALL"),
    "conflicting_fields": (conflicting_fields, f"{_PROV} SELECT component, count(DISTINCT value) AS n_values FROM pv WHERE field = 'wikidata_qid' GROUP BY component HAVING count(DISTINCT value) > 1"),
    "company_dedup": (company_dedup, f"""WITH e AS (SELECT p_partkey AS row, CASE p_partkey % 9 WHEN 0 THEN 'Read More' WHEN 1 THEN 'Alias  ' || p_partkey % 5 ELSE {_INIT} || CASE WHEN p_partkey % 2 = 0 THEN ' Inc.' ELSE '' END END AS raw, CASE WHEN p_partkey % 4 = 0 THEN 'C' || p_partkey END AS cusip FROM part),
      n AS (SELECT *, lower({_SQUEEZE("replace(raw, '.', '')")}) AS norm, CASE lower({_SQUEEZE('raw')}) WHEN 'alias 1' THEN 'Red Widget Corp.' WHEN 'alias 2' THEN 'Brand-New Company' END AS canon FROM e WHERE row % 31 <> 0),
      f AS (SELECT *, regexp_replace(coalesce(CASE canon WHEN 'Red Widget Corp.' THEN 'red widget corp' WHEN 'Brand-New Company' THEN 'brandnew company' END, norm), '{_TAIL(names.LEGAL_TAIL)}', '') AS key FROM n WHERE raw <> 'Read More'),
      g AS (SELECT key, count(*) AS edge_count, min(row) AS first FROM f GROUP BY key), o AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM g)
      SELECT o.key, coalesce(canon, raw) AS company_canonical_name, norm AS company_normalized_name, cusip, edge_count, printf('co:%04d-%04d:%s', n // 10000, n % 10000, replace(o.key, ' ', '-')) AS company_id FROM o JOIN f ON f.key = o.key AND f.row = first"""),
    "shared_companies": (shared_companies, "SELECT o_custkey, count(DISTINCT l_suppkey) AS n_investors, count(*) AS n_edges FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2 ORDER BY n_investors DESC, o_custkey LIMIT 20"),
    "fk_pk_violations": (fk_pk_violations, "SELECT count(*) AS n, 'pk' AS \"check\" FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT count(*), 'fk' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"),
    "overlay_left_join": (overlay_left_join, f"""WITH {_IFACE} SELECT event_id, CASE n % 8 WHEN 0 THEN 'base' WHEN 4 THEN NULL ELSE investor_id END AS investor_id, raw_investor_name, CASE WHEN n % 8 = 4 THEN 'ae' || event_id END AS associated_entity_id,
      CASE WHEN n % 8 = 0 THEN 'canonical_resolved' WHEN n % 8 = 4 THEN 'associated_entity' WHEN investor_id IS NOT NULL THEN 'EXISTING_INVESTOR' ELSE 'UNRESOLVED' END AS counterparty_resolution_status FROM ix"""),
    "appended_collisions": (appended_collisions, """WITH b AS (SELECT 'i' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Q' || s_suppkey END AS q, 'supplier ' || s_suppkey AS nm FROM supplier),
      n AS (SELECT 'n' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Q' || (c_custkey * 7 % 1000) END AS q, 'supplier ' || (c_custkey * 3 % 2000) AS nm FROM customer),
      k AS (SELECT id AS investor_id, 'wikidata_qid' AS field, q AS value FROM n WHERE q IS NOT NULL UNION ALL SELECT id, 'name', nm FROM n), kb AS (SELECT 'wikidata_qid' AS field, q AS value FROM b WHERE q IS NOT NULL UNION SELECT 'name', nm FROM b)
      SELECT investor_id, field, value FROM k WHERE (field, value) IN (SELECT (field, value) FROM kb) OR (field, value) IN (SELECT (field, value) FROM k GROUP BY ALL HAVING count(DISTINCT investor_id) > 1)"""),
    "overlay_records": (overlay_records, f"SELECT doc_id, CASE WHEN length(text) >= 80 THEN [{_faults(len(OVERLAY_FAULTS))}][doc_id % {len(OVERLAY_FAULTS)} + 1] ELSE [{_faults(5)}][doc_id % {len(OVERLAY_FAULTS)} + 1] END AS messages FROM documents"),
    "identity_statuses": (identity_statuses, f"""WITH {_IFACE}, iv AS (SELECT 'supplier ' || (s_suppkey % 25 + CASE WHEN s_suppkey < 10 THEN 0 ELSE 5 END) AS nm, list(DISTINCT 'inv' || s_suppkey) AS ids FROM supplier GROUP BY 1),
      x AS (SELECT ix.*, n % 11 = 0 AS ae, CASE WHEN trim(raw_investor_name) <> '' THEN 'supplier ' || n % 30 END AS nm FROM ix), j AS (SELECT x.*, ids FROM x LEFT JOIN iv USING (nm)),
      s AS (SELECT event_id, ids, CASE WHEN investor_id IS NOT NULL THEN 'canonical_resolved' WHEN ae THEN 'associated_entity' WHEN len(ids) > 1 THEN 'ambiguous_identity' WHEN nm IS NULL THEN 'missing_identity' WHEN len(ids) = 1 THEN 'analysis_normalized_exact_candidate' ELSE 'unresolved_named' END AS identity_status FROM j)
      SELECT event_id, identity_status, CASE WHEN identity_status = 'analysis_normalized_exact_candidate' THEN ids[1] END AS candidate_id FROM s"""),
    "identity_package": (identity_package, f"WITH {_IFACE} SELECT raw_investor_name, count(DISTINCT event_id) AS n_events, sha256(string_agg(event_id, chr(10) ORDER BY event_id)) AS event_ids_sha256, min(event_id) AS first_event FROM ix WHERE investor_id IS NULL AND trim(raw_investor_name) <> '' GROUP BY 1"),
    "name_recovery": (name_recovery, f"""WITH {_IFACE} SELECT event_id, NULL::VARCHAR AS source_event_id, raw_investor_name FROM ix WHERE n % 6 <> 1
      UNION ALL SELECT 'int:' || substr(sha1(event_id || '|' || nm || '|' || o), 1, 20), event_id, raw FROM (SELECT event_id, o, CASE o WHEN 1 THEN 'Alpha ' || n % 9 ELSE 'Beta Fund' END AS raw, CASE o WHEN 1 THEN 'alpha ' || n % 9 ELSE 'beta' END AS nm FROM ix, (VALUES (1), (2)) v(o) WHERE n % 6 = 1)"""),
    "unique_key_remap": (unique_key_remap, """WITH b AS (SELECT s_suppkey::VARCHAR AS investor_id, 'Q' || s_suppkey % 90 AS qid, 'supplier ' || s_suppkey AS nm FROM supplier),
      q AS (SELECT qid, min(investor_id) AS qi FROM b GROUP BY qid HAVING count(DISTINCT investor_id) = 1), m AS (SELECT nm, min(investor_id) AS ni FROM b GROUP BY nm HAVING count(DISTINCT investor_id) = 1),
      l AS (SELECT 'L' || c_custkey AS legacy_id, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey % 150 END AS qid, 'supplier ' || c_custkey % 140 AS nm FROM customer),
      j AS (SELECT l.*, qi, ni FROM l LEFT JOIN q USING (qid) LEFT JOIN m USING (nm))
      SELECT legacy_id, CASE WHEN qi <> ni THEN NULL ELSE coalesce(qi, ni) END AS investor_id, CASE WHEN qi <> ni THEN 'conflict' WHEN qi IS NOT NULL THEN 'qid' WHEN ni IS NOT NULL THEN 'name' ELSE 'unmatched' END AS status FROM j"""),
    "quote_checks": (quote_checks, """WITH q AS (SELECT doc_id, source, lang, n_chars, text, (doc_id % 50)::INT AS a, substr(text, (doc_id % 50 + 1 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)::INT, 12) AS quote FROM documents)
      SELECT doc_id, length(quote) = 12 AND substr(text, a + 1, 12) = quote AS holds, sha256(from_hex(hex('interface-source-row-sha-v1') || '00' || """ + " || ".join(f"'{len(c):016X}' || hex('{c}') || '{12:016X}' || hex('large_string') || CASE WHEN {c} IS NULL THEN '{0:018X}' ELSE '01' || printf('%016X', octet_length({c}::BLOB)) || hex({c}) END" for c in ("source", "lang")) + """)) AS row_sha256 FROM q"""),
    "coverage_gaps": (coverage_gaps, "SELECT doc_id, 'missing' AS gap FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"),
    "html_links": (html_links, f"WITH {_LINKS} SELECT page_id, entry, name, href FROM li"),
    "edge_upsert": (edge_upsert, f"""WITH {_EDGES}, st AS (SELECT investor_id, c, x, min(row * 10 + o) AS first FROM ed, (VALUES (1), (2)) v(o), LATERAL (SELECT CASE WHEN n = 1 AND o = 1 THEN 'seed' WHEN n = 2 AND o = 1 THEN 'growth' WHEN n = 2 AND o = 2 THEN 'seed' END AS x) WHERE x IS NOT NULL GROUP BY ALL)
      SELECT investor_id, c AS company_normalized_name, min(row) AS row, coalesce(any_value(s.stages), '') AS stages, coalesce(string_agg(DISTINCT ind, ',' ORDER BY ind), '') AS industries, arg_min(url, row) FILTER (url IS NOT NULL) AS company_url, arg_min(pos, row) FILTER (pos IS NOT NULL) AS position
      FROM ed LEFT JOIN (SELECT investor_id, c, string_agg(x, ',' ORDER BY first) AS stages FROM st GROUP BY ALL) s USING (investor_id, c) GROUP BY ALL"""),
    "edge_coverage": (edge_coverage, f"WITH {_EDGES} SELECT investor_id, count(*) AS n_edges, count(DISTINCT c) AS n_companies, count(url) AS n_company_url, count(pos) AS n_position, count(*) FILTER (n IN (1, 2)) AS n_stage_at_investment, count(ind) AS n_industry FROM ed GROUP BY investor_id"),
    "edge_spot_check": (edge_spot_check, f"""WITH {_EDGES}, h AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY investor_id ORDER BY row) <= 20)
      SELECT investor_id, avg((k % 3 = 0)::INT) >= 0.3 AS boilerplate_names, avg((k % 3 = 1)::INT) >= 0.5 AS url_names, bool_and(url IS NULL) AS no_url, bool_and(n NOT IN (1, 2)) AS no_stage, bool_and(ind IS NULL) AS no_industry, bool_and(pos IS NULL) AS no_position FROM h GROUP BY investor_id"""),
    "selector_self_test": (selector_self_test, f"WITH {_LINKS} SELECT page_id, count(*) AS n_rows, count(*) BETWEEN 1 AND 6 AS in_bounds, count(*) FILTER (entry < 3 AND name IS NULL) = 0 AS named FROM li GROUP BY page_id"),
    "chain_contract": (chain_contract, f"""{_MIDDLE}, x AS (SELECT ch.company_id, ch.chain_sequence, (ch.company_id * 31 + ch.chain_sequence) % 17 AS r, count(*) FILTER (family = 'exposure') AS ne, count(*) FILTER (family = 'interface') AS ni
          FROM ch LEFT JOIN mid USING (company_id, chain_sequence) GROUP BY ALL),
      k AS (SELECT CASE r WHEN 1 THEN 'unknown company' WHEN 2 THEN 'label differs' WHEN 3 THEN 'unknown window status' WHEN 4 THEN 'end isn''t a day' WHEN 5 THEN 'undated chain with an end' WHEN 7 THEN 'start isn''t a day' WHEN 8 THEN 'participants differ' WHEN 9 THEN 'counts differ' WHEN 15 THEN 'repeated chain' END AS violation FROM x
        UNION ALL SELECT 'undated chain with events' FROM x WHERE r IN (5, 6) AND ne + ni > 0 UNION ALL SELECT 'repeated event' FROM x WHERE r = 10 AND ne > 0 UNION ALL SELECT 'missing event' FROM x WHERE r = 11 AND ne > 0
        UNION ALL SELECT 'event of another family' FROM x WHERE r = 12 AND ne + ni > 0 UNION ALL SELECT 'event of another company' FROM x WHERE (r = 1 OR r = 13 AND company_id <> 0) AND ne + ni > 0 UNION ALL SELECT 'event of another type' FROM x WHERE r = 14 AND ne > 0
        UNION ALL SELECT 'repeated company' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 50 = 0) UNION ALL SELECT 'event of an unknown company' FROM ev WHERE family <> 'outcome' AND event_id::BIGINT % 50 = 0)
      SELECT violation, count(*) AS n FROM k WHERE violation IS NOT NULL GROUP BY violation"""),
    "newest_partition": (newest_partition, "WITH p AS (SELECT regexp_extract(url, '^http://([^/]+)/', 1) AS slug, '2024-01-01'::DATE + (page_id % 90)::INT AS day, page_id FROM pages) SELECT slug, max(day) AS newest, arg_max(page_id, (day, page_id)) AS page_id FROM p GROUP BY slug"),
}
