"""Leakage scan: pattern families over documents, with a severity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of patterns, read without regard to case.
FAMILIES = {
    "ipo_public": {
        "ticker_exchange_colon": r"\b(NYSE|NASDAQ|NASDAQGS|NASDAQGM|NYSEAMEX|AMEX|OTC|OTCQX|OTCQB|OTCBB|OTCPINK|LSE|LON|HKEX|SEHK|HKG|ASX|SGX|BSE|NSE|SHA|SSE|SHSE|SZSE|SZSC|BOM|TSX|TSXV|CVE|NEO|BME|EPA|ETR|FSE|TASE|KRX|KOSDAQ|BMV|BOVESPA|B3|SET|IDX|JSE|EGX|MOEX|SGXNET|CBOE)\s*:\s*[A-Z0-9\.]{1,8}\b",
        "ticker_paren": r"\([A-Z]{1,6}\s*:\s*[A-Z0-9\.]{2,8}\)",
        "listed_on_exchange": r"\b(?:listed on|traded on|floats? on|floated on|debuted on)\s+(?:the\s+)?(?:NYSE|NASDAQ|LSE|HKEX|TSX|ASX|SGX|BSE|NSE)",
        "public_keyword": r"\b(?:publicly[\s-]traded|publicly[\s-]listed|went public|IPO(?:ed|'d|d)?\s+in|initial public offering)\b",
        "ipo_year": r"\bIPO\s+(?:in|on|at)\s+\d{4}",
        "market_cap": r"\bmarket\s+cap(?:italization)?\s+of\s+\$\d",
        "share_price": r"\bshare\s+price\s+of\s+\$\d",
        "trading_at": r"\btrading\s+at\s+\$\d",
        "field_public_yes": r"\*\*Public/private\*\*:\s*`?\s*public\s*`?",
    },
    "acquisition": {
        "acquired_by_upper": r"\bacquired\s+by\s+[A-Z]",
        "acquired_for_dollar": r"\bacquired\s+for\s+\$",
        "acquisition_by": r"\b(?:acquisition|takeover|buyout)\s+by\s+[A-Z]",
        "was_acquired": r"\bwas\s+acquired\b",
        "has_been_acquired": r"\bhas\s+been\s+acquired\b",
        "got_acquired": r"\bgot\s+acquired\b",
        "was_purchased_by": r"\bwas\s+purchased\s+by\s+[A-Z]",
        "purchased_by": r"\bpurchased\s+by\s+[A-Z]",
        "bought_by": r"\bbought\s+by\s+[A-Z]",
        "merged_with": r"\bmerged\s+(?:with|into)\s+[A-Z]",
        "merger_of": r"\bmerger\s+(?:with|of)\s+[A-Z]",
        "subsidiary_of": r"\bwholly[\s-]owned\s+subsidiary\s+of\b",
        "now_part_of": r"\bnow\s+(?:part\s+of|owned\s+by|a\s+subsidiary\s+of)\s+[A-Z]",
        "now_known_as": r"\bnow\s+known\s+as\s+[A-Z]",
        "now_operates_as": r"\bnow\s+operates\s+as\s+[A-Z]",
        "formerly_known_as": r"\bformerly\s+known\s+as\s+[A-Z]",
        "rebranded": r"\brebranded\s+(?:as|to)\s+[A-Z]",
        "merging_with": r"\bmerging\s+(?:with|into)\s+[A-Z]",
    },
    "shutdown": {
        "shutdown_keyword": r"\b(?:shut\s+down|shutdown|shuttered|ceased\s+operations?|ceased\s+trading|wound\s+down|wound\s+up|dissolved|liquidat(?:ed|ion|ing)|bankruptcy|bankrupt|insolven(?:t|cy))\b",
        "no_longer_active": r"\bno\s+longer\s+(?:active|operating|in\s+business|trading|exists?)\b",
        "defunct": r"\b(?:defunct|inactive|dormant|abandoned|discontinued|folded|failed\s+company)\b",
        "domain_for_sale": r"\bdomain\s+(?:for\s+sale|resale|being\s+resold|is\s+being\s+marketed|for-sale|has\s+been\s+resold)\b",
        "premium_domain": r"\bpremium\s+domain\b",
        "domain_broker_email": r"\bacquisitions?@[a-zA-Z0-9\.\-_]+",
        "domain_broker_name": r"\b(?:DomainPointe|Sedo|GoDaddy Auctions|Undeveloped|Efty|Dan\.com|Squadhelp|BrandBucket)\b",
        "went_out_of_business": r"\bwent\s+out\s+of\s+business\b",
        "ceased_to_exist": r"\bceased\s+to\s+(?:exist|operate|trade)\b",
        "startup_failed": r"\b(?:startup|company|business)\s+failed\b",
        "shut_its_doors": r"\bshut\s+its\s+doors?\b",
        "pivoted_off": r"\bpivoted\s+off\b",
        "this_domain_for_sale": r"\b(?:this\s+domain|the\s+domain)\s+is\s+for\s+sale",
        "domain_available_for_purchase": r"\bavailable\s+for\s+purchase\b",
        "website_down": r"\bwebsite\s+(?:is\s+)?(?:down|offline|not\s+responding|inaccessible)\b",
        "http_404": r"\b404\s+(?:Not\s+Found|error)?\b",
        "dead_link": r"\bdead\s+link\b",
    },
    "funding": {
        "series_bcdefgh": r"\bSeries\s+[BCDEFGHIJ][+]?\b",
        "raised_amount": r"\braised\s+\$?\d+(?:\.\d+)?\s*[MBKmbk]?\s+(?:in|from|by|Series|Round|funding|financing)",
        "dollar_amount_raised": r"\$\d+(?:\.\d+)?\s*(?:million|billion|B|M)\s+(?:raised|in\s+funding|Series|investment|round|financing)\b",
        "unicorn": r"\bunicorn(?:\s+status)?\b",
        "billion_valuation": r"\$\d+(?:\.\d+)?\s*(?:billion|B)\s+(?:valuation|valued\s+at|market\s+cap)",
        "pre_post_money": r"\b(?:pre|post)-money\s+valuation\b",
        "post_series": r"\bpost-Series\s+[A-J]",
        "exited_at_dollar": r"\bexited\s+(?:at|for)\s+\$",
        "exit_of_dollar": r"\bexit\s+of\s+\$\d",
        "ipod_at": r"\bIPO'?d?\s+at\s+\$",
        "valuation_dollar": r"\bvaluation\s+of\s+\$\d+(?:\.\d+)?\s*(?:billion|million|B|M)",
    },
    "retrospective": {
        "already_realized": r"\balready\s+realized\b",
        "observed_outcome": r"\bobserved\b(?=.*(?:acquisition|shutdown|closed|wound|defunct))",
        "has_wound_down": r"\bhas\s+wound\s+down\b",
        "not_standalone": r"\bwas\s+not\s+standalone-defensible\b",
        "apparent_discontinuity": r"\bapparent\s+business\s+discontinuity\b",
        "terminal_candidate": r"\bterminal\s+to\s+this\s+candidate\b",
        "historically_successful": r"\bhistorically\s+successful\b",
        "exit_via": r"\bexit(?:ed)?\s+(?:via|through|by)\s+(?:IPO|acquisition)",
        "has_since": r"\bhas\s+since\s+(?:been|become|failed|shut|closed|acquired|been\s+acquired)",
        "currently_trading": r"\bcurrent(?:ly)?\s+(?:trading|listed|traded)\s+on\b",
        "recent_event": r"\brecent\s+(?:acquisition|shutdown|closure|wind[- ]?down)",
    },
}
#: What a hit in the proposal weighs, by family; the years after founding that are allowed.
WEIGHTS = {"ipo_public": 3, "acquisition": 3, "shutdown": 3, "funding": 2}
PUBLIC_WEIGHT, YEARS_WEIGHT, RETROSPECTIVE_WEIGHT, GRACE = 3, 1, 1, 2


#: A boundary of ASCII words; Java's own takes letters of any script for parts of a word, or not, by its version.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_SPACES = r" \t\n\f\r"
#: What folds to an ASCII letter beside the other case: the long s and the Kelvin sign.
_FOLDED = {"s": "\u017f", "k": "\u212a"}


def portable(pattern: str) -> str:
    """The expression as RE2 and others read it, without regard to case, for Java: words and spaces are ASCII, a line ends with a line feed only."""

    def translated(token: str) -> str:
        if token.startswith("["):
            folded = "".join(c for letter, c in _FOLDED.items() if re.fullmatch(token, letter, re.IGNORECASE))
            return token[:-1].replace(r"\s", _SPACES) + ("" if token.startswith("[^") else folded) + "]"
        if token.lower() in _FOLDED:
            return f"[{token}{_FOLDED[token.lower()]}]"
        return {r"\b": BOUNDARY, r"\s": f"[{_SPACES}]"}.get(token, token)

    return "(?id)" + "".join(map(translated, re.findall(r"\[\^?(?:\\.|[^\]\\])+\]|\\.|.", pattern, re.DOTALL)))


def loose(pattern: str) -> str:
    """An expression that finds something wherever portable() does, in text without folded letters; quick, since it has no boundaries."""
    return "(?id)" + re.sub(r"\\(.)", lambda m: "" if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def odd_letters(text: Column) -> Column:
    return text.contains(_FOLDED["s"]) | text.contains(_FOLDED["k"])


def _found(text: Column, pattern: str, odd: Column) -> Column:
    return F.when(odd | text.rlike(loose(pattern)), F.regexp_extract_all(text, F.lit(portable(pattern)), 0)).otherwise(F.array().cast("array<string>"))


def hits(docs: DataFrame, id_col: str, text_col: str, families: dict[str, dict[str, str]] = FAMILIES) -> DataFrame:
    """Long form: document, family, pattern, matches (array), for every pattern that matches."""
    found = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("pattern"), _found(F.col(text_col), p, F.col("_odd")).alias("matches")) for f, ps in families.items() for n, p in ps.items()]
    docs = docs.select(id_col, text_col, odd_letters(F.col(text_col)).alias("_odd"))
    rows = docs.select(id_col, F.explode(F.filter(F.array(*found), lambda h: F.size(h["matches"]) > 0)).alias("h"))
    return rows.select(id_col, "h.family", "h.pattern", "h.matches")


def family_counts(docs: DataFrame, id_col: str, text_col: str, families: dict[str, dict[str, str]] = FAMILIES) -> DataFrame:
    """One row per document, with the number of matches of each family."""
    counts = [sum((F.size(_found(F.col(text_col), p, F.col("_odd"))) for p in ps.values()), F.lit(0)).cast("long").alias(f"n_{f}") for f, ps in families.items()]
    return docs.select("*", odd_letters(F.col(text_col)).alias("_odd")).select(id_col, *counts)


#: The expressions that find a card's parts, and the length of a description without an end.
FOUNDING_YEAR = r"\*\*Founding\s+year\*\*:\s*`?(\d{4})`?"
FOUNDED_ON = r"Founded\s+(\d{4})-\d{2}-\d{2}"
PUBLIC_FIELD = r"(?i)\*\*Public/private\*\*:\s*`?\s*(public|private|equivocal|delisted)\s*`?"
PROPOSAL = r"(?s)\*\*Original proposal description\*\*:(.*)$"
PROPOSAL_END = r"\n\*\*[^*]+\*\*:|\n---"
PROPOSAL_LENGTH = 3000
SECTIONS = r"(?s)(---\s*\n\s*## 1\..*)$"
YEAR = r"\b(20\d{2})\b"


def founding_year(card: Column) -> Column:
    first = lambda pattern: F.nullif(F.regexp_extract(card, pattern, 1), F.lit(""))
    return F.coalesce(first(FOUNDING_YEAR), first(FOUNDED_ON)).cast("int")


def public_field(card: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(card, PUBLIC_FIELD, 1)), F.lit(""))


def proposal(card: Column) -> Column:
    """The original description: up to the next bold field or rule, or PROPOSAL_LENGTH characters where there is none."""
    after = F.regexp_extract(card, PROPOSAL, 1)
    bounded = F.regexp_extract(after, f"(?s)^(.*?)(?:{PROPOSAL_END})", 1)
    return F.trim(F.when(after.rlike(PROPOSAL_END), bounded).otherwise(F.substring(after, 1, PROPOSAL_LENGTH)))


def sections(card: Column) -> Column:
    """Everything from the first numbered section on."""
    return F.regexp_extract(card, SECTIONS, 1)


def late_years(text: Column, founded: Column) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(portable(YEAR)), 1), lambda y: y.cast("int"))
    return F.coalesce(F.filter(years, lambda y: y > founded + GRACE), F.array().cast("array<int>"))


def any_of(text: Column, family: str) -> Column:
    patterns = FAMILIES[family].values()
    either = lambda form: "|".join(f"(?:{form(p)})" for p in patterns)
    return F.coalesce((odd_letters(text) | text.rlike(either(loose))) & text.rlike(either(portable)), F.lit(False))


def severity(score: Column) -> Column:
    return F.when(score >= 3, "HIGH").when(score >= 1, "MED").otherwise("LOW")


def scan(cards: DataFrame, id_col: str = "card_id", text_col: str = "text") -> DataFrame:
    """One row per card: founding year, field, lengths, late years, score and severity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cards.select(id_col, founding_year(text).alias("founding_year"), public_field(text).alias("public_private_field"), proposal(text).alias("_p"), sections(text).alias("_s"))
    rows = rows.withColumn("post_founding_years", late_years(F.col("_p"), F.col("founding_year")))
    one = lambda c, w: F.when(c, w).otherwise(0)
    score = one(F.coalesce(F.col("public_private_field") == "public", F.lit(False)), PUBLIC_WEIGHT) + one(F.size("post_founding_years") > 0, YEARS_WEIGHT) + one(any_of(F.col("_s"), "retrospective"), RETROSPECTIVE_WEIGHT)
    for family, weight in WEIGHTS.items():
        score = score + one(any_of(F.col("_p"), family), weight)
    rows = rows.withColumn("severity_score", score)
    return rows.select(id_col, "founding_year", "public_private_field", F.length("_p").alias("proposal_desc_length"), F.length("_s").alias("llm_sections_length"), "post_founding_years", "severity_score", severity(F.col("severity_score")).alias("severity"))
