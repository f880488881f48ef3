"""Overlays on interface events: recovered names, identity decisions, remapped identifiers, coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import names


def unique_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that stand for exactly one value; null keys don't."""
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value))
    return one.filter("_n = 1").drop("_n")


def legacy_to_base(legacy: DataFrame, base: DataFrame) -> DataFrame:
    """(legacy_id, investor_id, status): by a unique qid or a unique exact name; both must agree where both are found.

    legacy: legacy_id, wikidata_qid, name; base: investor_id, wikidata_qid, name.
    """
    named = base.withColumn("_exact", names.exact_name(F.col("name")))
    by_qid = unique_keys(base, "wikidata_qid", "investor_id").withColumnRenamed("investor_id", "_q")
    by_name = unique_keys(named, "_exact", "investor_id").withColumnRenamed("investor_id", "_n")
    joined = legacy.withColumn("_exact", names.exact_name(F.col("name"))).join(by_qid, "wikidata_qid", "left").join(by_name, "_exact", "left")
    conflict = F.col("_q").isNotNull() & F.col("_n").isNotNull() & (F.col("_q") != F.col("_n"))
    status = F.when(conflict, "conflict").when(F.col("_q").isNotNull(), "qid").when(F.col("_n").isNotNull(), "name").otherwise("unmatched")
    return joined.select("legacy_id", F.when(~conflict, F.coalesce("_q", "_n")).alias("investor_id"), status.alias("status"))


def remap(provenance: DataFrame, mapping: DataFrame, id_col: str = "investor_id") -> DataFrame:
    """Provenance under the base identifiers; rows without one go."""
    m = mapping.filter(F.col("investor_id").isNotNull()).select(F.col("legacy_id").alias(id_col), F.col("investor_id").alias("_to"))
    return provenance.join(m, id_col).withColumn(id_col, F.col("_to")).drop("_to")


def apply_resolutions(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds associated_entity_id and counterparty_resolution_status.

    A resolution decides on the investor, none too; without one the event's own investor is
    an existing one, and an event without any is unresolved.
    resolutions: event_id, investor_id, associated_entity_id, status.
    """
    r = resolutions.select("event_id", F.struct(F.col("investor_id").alias("i"), F.col("associated_entity_id").alias("a"), F.col("status").alias("s")).alias("_r"))
    joined = events.join(r, "event_id", "left")
    given = F.col("_r").isNotNull()
    default = F.when(F.coalesce(F.col("investor_id"), F.lit("")) != "", "EXISTING_INVESTOR").otherwise("UNRESOLVED")
    return joined.withColumns({"investor_id": F.when(given, F.col("_r.i")).otherwise(F.col("investor_id")), "associated_entity_id": F.col("_r.a"), "counterparty_resolution_status": F.when(given, F.col("_r.s")).otherwise(default)}).drop("_r")


def appended_collisions(base: DataFrame, added: DataFrame) -> DataFrame:
    """(investor_id, field, value) of added investors that share an identifier, a qid or an exact name with the base or with another added one.

    What is repeated inside the base stays. base and added: investor_id, wikidata_qid, name.
    """

    def keys(rows: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in (("investor_id", F.col("investor_id")), ("wikidata_qid", F.col("wikidata_qid")), ("name", names.exact_name(F.col("name"))))])
        return rows.select("investor_id", F.explode(each).alias("k")).select("investor_id", "k.field", "k.value").filter(F.coalesce(F.col("value"), F.lit("")) != "")

    of_base = keys(base).select("field", "value").distinct()
    mine = keys(added)
    with_base = mine.join(of_base, ["field", "value"], "left_semi")
    several = mine.groupBy("field", "value").agg(F.count_distinct("investor_id").alias("ids"), F.count(F.lit(1)).alias("n")).filter("ids > 1 OR field = 'investor_id' AND n > 1").select("field", "value")
    return with_base.unionByName(mine.join(several, ["field", "value"], "left_semi")).distinct().select("investor_id", "field", "value")


def conflicting_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for several values: a map by that key would have to refuse them."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


#: What a recovery record, a name in it and its evidence hold; where evidence comes from; the statuses.
RECORD_KEYS = ("names", "record_id", "schema_version", "source_event_id", "source_row_sha256", "status")
NAME_KEYS = ("evidence", "ordinal", "raw_investor_name")
EVIDENCE_KEYS = ("name_end_in_quote", "name_start_in_quote", "quote", "quote_end", "quote_start", "source_field")
SOURCE_FIELDS = ("title", "summary", "source_page")
RECOVERED, NOBODY, AMBIGUOUS = "RECOVERED", "NO_IDENTIFIABLE_COUNTERPARTY", "AMBIGUOUS"
_EVIDENCE = "struct<source_field:string,quote:string,quote_start:bigint,quote_end:bigint,name_start_in_quote:bigint,name_end_in_quote:bigint,source_url:string>"
_NAMES = f"array<struct<ordinal:bigint,raw_investor_name:string,evidence:{_EVIDENCE}>>"


def overlay_messages(record: Column, version: str, event_id: Column, row_hash: Column, title: Column, summary: Column, source_url: Column) -> Column:
    """What is wrong with a recovery record (JSON text) about a source row, as an array of messages.

    Closed keys, its binding to the row, and for each name an ordinal from 1 and offsets at
    which quote and name stand in their source word for word.
    """
    part = lambda path, kind: F.from_json(F.get_json_object(record, path), kind)
    text = lambda key: F.get_json_object(record, f"$.{key}")
    keys_of = lambda m: F.array_sort(F.map_keys(m))
    listed = lambda keys: F.array(*map(F.lit, sorted(keys)))
    found = part("$.names", _NAMES)
    maps = part("$.names", "array<map<string,string>>")
    evidence_maps = F.transform(maps, lambda m: F.from_json(m["evidence"], "map<string,string>"))

    def offsets_fail(n: Column) -> Column:
        e, name = n["evidence"], n["raw_investor_name"]
        cut = lambda whole, a, b: F.substring(whole, a + 1, b - a)
        source = F.when(e["source_field"] == "title", title).when(e["source_field"] == "summary", summary)
        quote = F.coalesce(e["quote"], F.lit(""))
        spans = (e["quote_start"] >= 0) & (e["name_start_in_quote"] >= 0) & (e["quote_start"] < e["quote_end"]) & (e["name_start_in_quote"] < e["name_end_in_quote"]) & (e["name_end_in_quote"] <= F.length(quote))
        in_row = (e["quote_end"] <= F.length(source)) & (cut(source, e["quote_start"], e["quote_end"]) == quote) & e["source_url"].isNull()
        on_page = (e["quote_end"] <= F.length(quote)) & (e["quote_start"] <= e["name_start_in_quote"]) & (e["name_end_in_quote"] <= e["quote_end"]) & (e["source_url"] == source_url) & (source_url != "")
        stands = F.when(e["source_field"] == "source_page", on_page).otherwise(in_row)
        return ~F.coalesce((quote != "") & spans & stands & (cut(quote, e["name_start_in_quote"], e["name_end_in_quote"]) == name), F.lit(False))

    ordinals = F.array_sort(F.transform(found, lambda n: n["ordinal"]))
    raw = F.transform(found, lambda n: n["raw_investor_name"])
    size = F.coalesce(F.size(found), F.lit(-1))
    tests = (
        (~F.coalesce(keys_of(F.from_json(record, "map<string,string>")) == listed(RECORD_KEYS), F.lit(False)), "the record's fields don't match the schema"),
        (~text("schema_version").eqNullSafe(F.lit(version)), "schema_version is invalid"),
        (~text("source_event_id").eqNullSafe(event_id) | ~text("source_event_id").rlike("^int:[0-9a-f]{20}$"), "the record is of another event"),
        (~text("source_row_sha256").eqNullSafe(row_hash), "the source row has another digest"),
        (~text("record_id").eqNullSafe(names.record_id(version, event_id, row_hash)), "record_id doesn't match its source"),
        (~F.coalesce(text("status").isin(RECOVERED, NOBODY, AMBIGUOUS), F.lit(False)), "status is invalid"),
        (size < 0, "names must be an array"),
        ((text("status") == RECOVERED) & (size == 0), "a recovered record needs a name"),
        ((text("status") == NOBODY) & (size > 0), "a record of nobody has names"),
        (F.exists(maps, lambda m: keys_of(m) != listed(NAME_KEYS)), "a name's fields don't match the schema"),
        (F.exists(evidence_maps, lambda m: ~F.coalesce((keys_of(m) == listed(EVIDENCE_KEYS)) | (keys_of(m) == listed((*EVIDENCE_KEYS, "source_url"))), F.lit(False))), "the evidence's fields don't match the schema"),
        (F.exists(found, lambda n: ~F.coalesce(n["evidence"]["source_field"].isin(*SOURCE_FIELDS), F.lit(False))), "the evidence is from nowhere"),
        ((size > 0) & (ordinals != F.sequence(F.lit(1).cast("long"), F.greatest(size, F.lit(1)).cast("long"))), "ordinals aren't 1 and on"),
        (F.size(F.array_distinct(raw)) != size, "a name is there twice"),
        (F.exists(found, lambda n: F.coalesce(names.squeeze(n["raw_investor_name"]), F.lit("")) == ""), "a name is blank"),
        (F.exists(found, offsets_fail), "a quote or name doesn't stand where it is said to"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"FAIL: {what}")) for wrong, what in tests]))


def identity_status(events: DataFrame, investors: DataFrame) -> DataFrame:
    """The status of each event's counterparty, and the candidate that its normalized name stands for.

    investors: investor_id, normalized_name; a name of several investors is ambiguous.
    """
    by_name = investors.groupBy(F.col("normalized_name").alias("_name")).agg(F.array_sort(F.collect_set("investor_id")).alias("_ids"))
    rows = events.withColumn("_name", F.nullif(names.normalize_name(F.col("raw_investor_name")), F.lit(""))).join(by_name, "_name", "left")
    status = (
        F.when(F.col("investor_id").isNotNull(), "canonical_resolved")
        .when(F.col("associated_entity_id").isNotNull(), "associated_entity")
        .when(F.size("_ids") > 1, "ambiguous_identity")
        .when(F.col("_name").isNull(), "missing_identity")
        .when(F.size("_ids") == 1, "analysis_normalized_exact_candidate")
        .otherwise("unresolved_named")
    )
    return rows.withColumns({"identity_status": status, "candidate_id": F.when(status == "analysis_normalized_exact_candidate", F.col("_ids")[0])}).drop("_name", "_ids")


def package_rows(events: DataFrame) -> DataFrame:
    """Unresolved names with their events: raw_investor_name, sorted event identifiers, how many, and their digest."""
    rows = events.filter(F.col("investor_id").isNull() & F.col("raw_investor_name").isNotNull() & (F.trim("raw_investor_name") != ""))
    return rows.groupBy("raw_investor_name").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.count_distinct("event_id").alias("n_events"), names.id_set_sha256(F.col("event_id")).alias("event_ids_sha256"))


def recovered(events: DataFrame, overlay: DataFrame) -> DataFrame:
    """Events of the overlay once for each recovered name, in the order of the names, with new identifiers; others as they are.

    overlay: source_event_id, recovered: array of (ordinal, raw_investor_name).
    """
    o = overlay.select(F.col("source_event_id").alias("event_id"), F.array_sort("recovered").alias("_names"))
    joined = events.join(o, "event_id", "left").withColumn("_one", F.explode_outer("_names"))
    fresh = F.col("_one").isNotNull()
    key = names.hash_id("int", F.col("event_id"), names.normalize_name(F.col("_one.raw_investor_name")), F.col("_one.ordinal"))
    return joined.withColumns(
        {
            "source_event_id": F.when(fresh, F.col("event_id")),
            "event_id": F.when(fresh, key).otherwise(F.col("event_id")),
            "raw_investor_name": F.when(fresh, F.col("_one.raw_investor_name")).otherwise(F.col("raw_investor_name")),
        }
    ).drop("_names", "_one")


def entity_rows(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows in the columns of the entity table, cast to its types; what they lack is null, and what is more goes. Dates become text where text is asked for."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def quote_holds(source: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether a quote stands in its source where it is said to: characters from start to before end."""
    return F.coalesce((F.length(quote) == end - start) & F.substring(source, start + 1, end - start).eqNullSafe(quote), F.lit(False))


#: The name of the row digest, and the types that it writes for a text and a number.
ROW_DIGEST, TEXT_TYPE, NUMBER_TYPE = "interface-source-row-sha-v1", "large_string", "double"


def _eight(number: Column) -> Column:
    """A whole number as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a whole number: sign, exponent and fraction, put together by exact arithmetic."""
    two = lambda e: F.pow(F.lit(2.0), e)
    size = F.abs(value)
    about = F.floor(F.log2(size))
    exponent = F.greatest(about + F.when(size / two(about) >= 2, 1).when(size / two(about) < 1, -1).otherwise(0), F.lit(-1022))
    normal = F.shiftleft(exponent.cast("long") + 1023, 52) + ((size / two(exponent) - 1) * two(F.lit(52.0))).cast("long")
    small = (size * two(F.lit(537.0)) * two(F.lit(537.0))).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size < two(F.lit(-1022.0)), small).otherwise(normal)
    bits = F.when(F.isnan(value), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF << 52)).otherwise(bits)
    return F.when(value.cast("string").startswith("-"), bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)


def row_sha256(*columns: str, doubles: tuple[str, ...] = ()) -> Column:
    """The digest of a row of texts (and ``doubles``), whatever file it comes from.

    For each column: the lengths and bytes of its name and type, then a zero and an empty
    length for null, or a one with the length and bytes of the value.
    """
    sized = lambda raw: F.concat(_eight(F.octet_length(raw)), raw)
    parts = [F.encode(F.lit(ROW_DIGEST + "\0"), "utf-8")]
    for c in columns:
        number = c in doubles
        value = _eight(double_bits(F.col(c).cast("double"))) if number else F.encode(F.col(c).cast("string"), "utf-8")
        parts += [sized(F.encode(F.lit(x), "utf-8")) for x in (c, NUMBER_TYPE if number else TEXT_TYPE)]
        parts.append(F.coalesce(F.concat(F.unhex(F.lit("01")), sized(value)), F.unhex(F.lit("00" * 9))))
    return F.sha2(F.concat(*parts), 256)


def coverage_gaps(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks: missing ones, and unexpected ones."""
    w, g = wanted.select(key).distinct(), given.select(key).distinct()
    return w.join(g, key, "left_anti").withColumn("gap", F.lit("missing")).unionByName(g.join(w, key, "left_anti").withColumn("gap", F.lit("unexpected")))
