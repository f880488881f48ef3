"""Checks of JSON documents (market, moat, evaluation) as arrays of messages, and search queries from templates.

A document is a JSON text; its checks are rows of a small language: a path, what the value
must be, and the message's weight. They are compiled to Columns over a parsed variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import names

#: Scales that documents use.
VERDICTS = {"PASS": "✅", "WARN": "⚠", "FAIL": "🔴"}
PORTER_DISCOUNTS, PORTER_LEVELS = (0.25, 0.5, 0.75, 1.0), ("high", "med", "low")
MOATS = ("Network Economies", "Scale", "Cornered Resource", "Process Power", "Brand", "Switching Costs", "Counter-positioning")
VRIO = {"✓": 1.0, "partial": 0.5, "✗": 0.0}
VRIO_PARTS = ("valuable", "rare", "inimitable", "organized")
#: Search queries for a proposal's market and moat.
MARKET_QUERIES = (
    "{{target_market}} market size forecast",
    "{{sub_segment}} top players market share incumbents",
    "{{sub_segment}} growth rate CAGR demand trend",
    "{{target_market}} TAM analyst Gartner IDC Sacra",
    "{{sub_segment}} commoditization OSS substitute risk",
)
MOAT_QUERIES = (
    "{{moat_claim}} {{target_market}} incumbent moat depth defensibility",
    "{{moat_claim}} {{specialty_capability}} barrier to imitation",
    "{{target_market}} {{moat_claim}} category erosion commoditization",
    "{{moat_claim}} competition {{geographic_scope}} landscape",
)


#: The first word of a variant's schema, and the kind that it stands for; any other is null.
KINDS = {"missing": "missing", "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"} | dict.fromkeys(("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE"), "number")


class Doc:
    """The messages about a document, and the facts that they rest on.

    A fact (what a path holds, and of what kind) is read once from the document, however
    many messages use it. Without facts, a Doc only takes down which ones are asked for.
    """

    def __init__(self, facts: Column | None = None):
        self.facts = facts
        self.asked: dict[str, Callable[[Column], Column]] = {}
        self.found: list[Column] = []

    def fact(self, name: str, of_root: Callable[[Column], Column]) -> Column:
        self.asked.setdefault(name, of_root)
        return F.lit(None) if self.facts is None else self.facts[name]

    def get(self, path: str, kind: str = "string") -> Column:
        return self.fact(f"{kind} {path}", lambda root: F.try_variant_get(root, f"$.{path}" if path else "$", kind))

    def kind(self, path: str) -> Column:
        """object, array, number, string, boolean, null, or missing."""

        def of(root: Column) -> Column:
            schema = F.schema_of_variant(F.try_variant_get(root, f"$.{path}" if path else "$", "variant"))
            word = F.substring_index(F.substring_index(F.coalesce(schema, F.lit("missing")), "<", 1), "(", 1)
            return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), word), F.lit("null"))

        return self.fact(f"kind {path}", of)

    def fail(self, wrong: Column, message: str, level: str = "FAIL") -> None:
        self.found.append(F.when(F.coalesce(wrong, F.lit(False)), F.lit(f"{level}: {message}")))

    def is_a(self, path: str, kind: str) -> Column:
        self.fail(self.kind(path) != kind, f"{path or 'the document'} must be {'an' if kind[0] in 'ao' else 'a'} {kind}")
        return self.kind(path) == kind

    def filled(self, path: str, given: Column | None = None) -> None:
        empty = self.kind(path).isin("missing", "null") | ((self.kind(path) == "string") & (F.trim(self.get(path)) == ""))
        self.fail(empty if given is None else given & empty, f"{path} is required")

    def one_of(self, path: str, values, given: Column | None = None) -> None:
        kind = "double" if isinstance(values[0], float) else "string"
        wrong = ~F.coalesce(self.get(path, kind).isin(*values), F.lit(False))
        self.fail(wrong if given is None else given & wrong, f"{path} isn't one of {', '.join(map(str, values))}")

    def number(self, path: str, low: float | None = None, high: float | None = None, given: Column | None = None) -> None:
        value = self.get(path, "double")
        wrong = self.kind(path) != "number"
        wrong = wrong | (value < low) if low is not None else wrong
        wrong = wrong | (value > high) if high is not None else wrong
        self.fail(wrong if given is None else given & wrong, f"{path} must be a number{'' if low is None else f' from {low}'}{'' if high is None else f' to {high}'}")

    def absent(self, path: str) -> None:
        self.fail(self.kind(path) != "missing", f"{path} isn't part of the schema")

    def head(self) -> None:
        """What all documents begin with: a verdict, its sign and its text."""
        self.one_of("verdict", tuple(VERDICTS))
        self.one_of("verdict_emoji", tuple(VERDICTS.values()))
        sign = F.element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), self.get("verdict"))
        self.fail(self.get("verdict").isin(*VERDICTS) & self.get("verdict_emoji").isin(*VERDICTS.values()) & (self.get("verdict_emoji") != sign), "verdict_emoji doesn't match the verdict")
        self.filled("verdict_text")

    def prose(self, path: str, least: int = 30, most: int = 250) -> None:
        """Words, with each Chinese character as one more, within bounds."""
        text = self.get(path)

        def words(root: Column) -> Column:
            prose = F.try_variant_get(root, f"$.{path}", "string")
            return F.size(F.regexp_extract_all(prose, F.lit(r"(?U)\w+"), 0)) + F.size(F.regexp_extract_all(prose, F.lit(r"[一-鿿]"), 0))

        n = self.fact(f"words {path}", words)
        self.filled(path)
        self.fail((F.trim(text) != "") & ~n.between(least, most), f"{path} is too short or too long", "WARN")

    def messages(self) -> Column:
        whole = self.kind("") == "object"
        return F.when(whole, F.array_compact(F.array(*self.found))).otherwise(F.array(F.lit("FAIL: the document must be an object")))


def _messages(text: Column, check: Callable[[Doc], Column]) -> Column:
    """A check's messages on a text: parsed once, then its facts, then what they say; variables of lambdas hold both."""
    asks = Doc()
    check(asks)
    facts = F.transform(F.array(F.try_parse_json(text)), lambda root: F.struct(*[of_root(root).alias(name) for name, of_root in asks.asked.items()]))
    return F.transform(facts, lambda x: check(Doc(x)))[0]


def market_messages(text: Column) -> Column:
    return _messages(text, _market)


def _market(d: Doc) -> Column:
    d.head()
    tam = d.is_a("tam", "object")
    for key in ("value_b", "scope", "source"):
        d.filled(f"tam.{key}", tam)
    pair = (d.kind("tam.range_b") == "array") & (d.kind("tam.range_b[0]") == "number") & (d.kind("tam.range_b[1]") == "number") & (d.kind("tam.range_b[2]") == "missing")
    d.fail(tam & ~pair, "tam.range_b must be a pair of numbers")
    sam, som = d.is_a("sam", "object"), d.is_a("som", "object")
    d.filled("sam.subset_descriptor", sam)
    d.number("sam.pct_of_tam", 0, 1, sam)
    d.number("som.locked_pct", 0, 1, som)
    d.one_of("som.porter_discount", PORTER_DISCOUNTS, som)
    d.number("som.headroom_b", 0, None, som)
    expected = d.get("tam.value_b", "double") * d.get("sam.pct_of_tam", "double") * (1 - d.get("som.locked_pct", "double")) * d.get("som.porter_discount", "double")
    stated = d.get("som.headroom_b", "double")
    d.fail(F.abs(stated - expected) > 0.05 * F.greatest(stated, expected, F.lit(0.01)), "som.headroom_b is off the formula by more than 5 %", "WARN")
    forces = d.is_a("porter_forces", "object")
    for key in ("rivalry", "substitutes", "new_entrants"):
        d.one_of(f"porter_forces.{key}", PORTER_LEVELS, forces)
    meta = d.is_a("search_metadata", "object")
    d.filled("search_metadata.timestamp", meta)
    d.fail(meta & ~d.kind("search_metadata.source_urls").isin("array", "missing"), "search_metadata.source_urls must be an array")
    d.filled("refresh_trigger.default_interval")
    d.prose("reasoning")
    return d.messages()


def moat_messages(text: Column) -> Column:
    return _messages(text, _moat)


def _moat(d: Doc) -> Column:
    d.head()
    claimed = d.get("claimed_moats", "array<variant>")
    d.fail(claimed.isNull() | (F.size(claimed) == 0), "claimed_moats must be an array that isn't empty")
    kind = lambda m: F.try_variant_get(m, "$.moat_type", "string")
    evidence = lambda m: F.coalesce(F.trim(F.try_variant_get(m, "$.evidence", "string")), F.lit(""))
    d.fail(F.exists(claimed, lambda m: ~F.coalesce(kind(m).isin(*MOATS), F.lit(False))), "claimed_moats has an unknown moat_type")
    d.fail(F.exists(claimed, lambda m: evidence(m) == ""), "claimed_moats lacks evidence")
    vrio = d.is_a("vrio_breakdown", "object")
    d.one_of("vrio_breakdown.dominant_moat", MOATS, vrio)
    values = F.create_map(*[F.lit(x) for kv in VRIO.items() for x in kv])
    total = F.lit(0.0)
    for part in VRIO_PARTS:
        d.one_of(f"vrio_breakdown.{part}.verdict", tuple(VRIO), vrio)
        d.filled(f"vrio_breakdown.{part}.evidence", vrio)
        total = total + F.element_at(values, d.get(f"vrio_breakdown.{part}.verdict"))
    d.number("vrio_breakdown.score", 0, 4, vrio)
    d.fail(F.abs(d.get("vrio_breakdown.score", "double") - total) > 0.05, "vrio_breakdown.score isn't the sum of its parts", "WARN")
    d.absent("dominant_moat_required")
    d.is_a("erosion_risks", "array")
    meta = d.is_a("search_metadata", "object")
    d.filled("search_metadata.timestamp", meta)
    d.prose("reasoning")
    return d.messages()


def evaluation_messages(text: Column) -> Column:
    return _messages(text, _evaluation)


def _evaluation(d: Doc) -> Column:
    d.head()
    d.absent("archetype")
    d.absent("hmu_breakdown")
    mu = d.is_a("mu_breakdown", "object")
    d.absent("mu_breakdown.h_check")
    for key in ("m_check", "u_check"):
        d.one_of(f"mu_breakdown.{key}.verdict", tuple(VERDICTS), mu)
    d.number("mu_breakdown.m_check.som_headroom_b", given=mu)
    d.number("mu_breakdown.u_check.vrio_score", 0, 4, mu)
    agg = d.is_a("aggregate", "object")
    d.number("aggregate.weighted_score", 0, 1, agg)
    weights = [d.get(f"aggregate.weights_used.{k}", "double") for k in ("m", "u")]
    d.fail(agg & (weights[0].isNull() | weights[1].isNull()), "aggregate.weights_used must have m and u")
    d.absent("aggregate.weights_used.h")
    d.fail(F.abs(weights[0] + weights[1] - 1.0) > 0.01, "aggregate.weights_used must add up to 1")
    d.one_of("aggregate.verdict_path", ("score_threshold",), agg)
    driver = d.is_a("dominant_driver", "object")
    d.one_of("dominant_driver.dim", ("M", "U"), driver)
    d.one_of("dominant_driver.verdict", tuple(VERDICTS), driver)
    d.filled("dominant_driver.reason", driver)
    d.prose("decision_rationale", 30, 300)
    meta = d.is_a("metadata", "object")
    d.filled("metadata.timestamp", meta)
    d.filled("metadata.framework_version", meta)
    d.fail(~d.get("metadata.framework_version").startswith("v1.5"), "metadata.framework_version isn't v1.5", "WARN")
    d.number("metadata.founding_year", 1900, 2099, meta)
    window = d.get("metadata.retrieval_window", "array<string>")
    d.fail(meta & ~F.coalesce((F.size(window) == 2) & F.forall(window, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)), "metadata.retrieval_window must be a pair of days")
    return d.messages()


def search_queries(spark: SparkSession, placeholders: DataFrame, templates: tuple[str, ...], id_col: str) -> DataFrame:
    """One row per placeholder row and template: the filled query, and whether a value was missing. placeholders: id and text columns."""
    values = {c: F.col(c) for c in placeholders.columns if c != id_col}
    filled = F.array(*[F.struct(F.lit(k).alias("query_no"), names.fill_template(t, values).alias("query")) for k, t in enumerate(templates)])
    return placeholders.select(id_col, F.explode(filled).alias("q")).select(id_col, "q.query_no", "q.query", F.col("q.query").contains("<null:").alias("unresolved"))
