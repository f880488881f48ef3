"""Names, slugs, URLs, stages and identifiers, as Columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words dropped from the end of an investor's name.
NAME_TAIL = ("ventures", "capital", "partners", "fund", "llc", "lp", "inc", "group", "advisors", "holdings", "investments", "management", "corp", "co", "corporation", "company")
#: Words dropped from the end of a company's name.
LEGAL_TAIL = ("inc", "corp", "ltd", "plc", "llc", "lp", "sa", "ag", "nv", "bv", "co", "company", "corporation", "limited", "group", "holdings", "international", "global", "industries")
#: Stage names as met, and the stage that each stands for.
STAGES = {
    "pre-seed": ("pre-seed", "preseed", "pre seed"),
    "seed": ("seed",),
    "series-a": ("series a", "series-a", "seriesa"),
    "series-b": ("series b", "series-b"),
    "series-c": ("series c", "series-c"),
    "series-d-plus": ("series d", "series-d", "series d+", "series d and later", "series d-plus", "series-d-plus", "series e", "series f", "series g"),
    "growth": ("growth", "growth stage"),
    "late-stage": ("late stage", "late-stage"),
    "pre-ipo": ("pre-ipo", "pre ipo"),
    "any": ("any", "any stage", "any-stage"),
}
#: What makes a scraped string no company name.
GARBAGE_PARTS = (
    "カテゴリー", "ステータス", "すべて", "その他", "もっと見る", "一致するものが見つかりませんでした", "初回投資年次",
    "トップメッセージ", "サステナビリティ", "ステークホルダー", "環境への取り組み", "社会への取り組み", "ガバナンス",
    "編集方針", "免責事項", "進入官網", "項目状態", "此列表仅为", "dtype object", "dtype: object",
)
GARBAGE_PATTERNS = (r"Founded[0-9]{4}", r"StageInvested", r"BackedSince[0-9]{4}", r"Status(Private|Public|Acquired|A\b)", r"Series\s+[A-Z],?\s*[0-9]{4}Read", r"^Acquired[A-Z]", r"Invested(Seed|Series)")
GARBAGE_WORDS = (
    "crunchbase", "read more", "view all", "load more", "see all", "learn more", "portfolio", "companies", "team", "about", "contact",
    "visit site", "website", "news", "blog", "careers", "jobs", "all", "other", "status", "category", "sector", "stage",
)
#: Parts of a logo's file name that are no part of a name, and image endings.
LOGO_WORDS = (
    "logo", "logotype", "logomark", "wordmark", "brandmark", "transparent", "horizontal", "vertical", "square", "landscape",
    "dark", "light", "black", "white", "primary", "secondary", "ko", "bg", "nobg", "sq", "cropped",
    "small", "medium", "large", "big", "hi", "lo", "hd", "final", "v1", "v2", "v3",
)
IMAGE_ENDINGS = ("webp", "png", "jpg", "jpeg", "gif", "svg", "ico")
#: Names of rounds, and the bucket of each.
ROUNDS = {
    "pre_seed": ("pre seed", "preseed"),
    "seed": ("seed",),
    "angel": ("angel",),
    "bridge_or_extension": ("bridge", "extension"),
    "convertible": ("convertible", "convertible note", "safe"),
    "debt": ("debt", "venture debt"),
    "grant": ("grant",),
    "crowdfunding": ("crowdfunding",),
    "private_equity": ("private equity", "pe"),
}
UNKNOWN_ROUNDS = ("unknown", "n/a", "na", "none", "pending", "undisclosed", "not disclosed")

#: Letters, numbers and underscores of any script; Java and RE2 read it alike.
WORD = r"\p{L}\p{M}\p{N}_"


#: White space of any script; Java's own class has that of ASCII only.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NOT_ASCII = r"[^\x00-\x7F]"


def squeeze(text: Column) -> Column:
    """Trimmed, with single spaces between."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose folded form isn't their lower case: those that become one letter, theirs, and those that become several."""
    odd = [(c, c.casefold()) for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c.lower()]
    one = [(c, f) for c, f in odd if len(f) == 1]
    return "".join(c for c, _ in one), "".join(f for _, f in one), [(c, f) for c, f in odd if len(f) > 1]


_FOLD_FROM, _FOLD_TO, _FOLD_MANY = _folding()


def casefold(text: Column) -> Column:
    """Lower case for comparisons, in any script (a sharp s is ss); within the JVM."""
    many = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in _FOLD_MANY])
    # Letters go before their lower case, which some of them don't come back from.
    whole = F.translate(F.aggregate(many, text, lambda t, m: F.replace(t, m["c"], m["f"])), _FOLD_FROM, _FOLD_TO)
    return F.when(text.rlike(_NOT_ASCII), F.translate(F.lower(whole), _FOLD_FROM, _FOLD_TO)).otherwise(F.lower(text))


def _without_tail(text: Column, tail: tuple[str, ...]) -> Column:
    return F.regexp_replace(text, f"(?:(?:^| )(?:{'|'.join(tail)}))+$", "")


def normalize_name(raw: Column) -> Column:
    """Lower case, punctuation but hyphens to spaces, without the words of NAME_TAIL at its end; null is empty."""
    return F.coalesce(_without_tail(squeeze(F.regexp_replace(F.lower(raw), rf"[^{WORD}\s-]", " ")), NAME_TAIL), F.lit(""))


def normalize_company_name(raw: Column) -> Column:
    """As normalize_name(), without hyphens and with LEGAL_TAIL; a name of such words only stays."""
    text = squeeze(F.regexp_replace(F.lower(raw), rf"[^{WORD}\s]", " "))
    return F.coalesce(F.nullif(_without_tail(text, LEGAL_TAIL), F.lit("")), text, F.lit(""))


def exact_name(raw: Column) -> Column:
    """Folded words with single spaces between."""
    return squeeze(F.regexp_replace(casefold(raw), rf"[^{WORD}]+", " "))


def dedup_key(raw: Column) -> Column:
    """For the manual alias table: case and runs of white space don't count."""
    return casefold(squeeze(raw))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, single spaces; empty is null. For text that isn't ASCII."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) or None)


def identity(raw: Column, compatible: bool = False) -> Column:
    """The key by which two mentions of a name are one: folded, single spaces; empty is null.

    With ``compatible``, letters that only look different (NFKC) are one too: names that
    aren't ASCII go to Python for that, others stay in the JVM.
    """
    if not compatible:
        return F.nullif(casefold(squeeze(raw)), F.lit(""))
    other = raw.rlike(_NOT_ASCII)
    return F.when(other, folded(F.when(other, raw))).otherwise(F.nullif(F.lower(squeeze(raw)), F.lit("")))


#: Runs without wide characters, which keep their form in a slug; and the words of a slug.
_NOT_WIDE = re.compile("[^぀-ヿ㐀-鿿가-힯＀-￯]+")
_SLUG_WORD = re.compile(r"\w+")


@F.pandas_udf(StringType())
def slug(name: pd.Series) -> pd.Series:
    """Lower-case words of any script joined by hyphens, Latin marks taken off, 50 characters at most."""

    def bare(run):
        return "".join(x for x in unicodedata.normalize("NFKD", run[0]) if not unicodedata.combining(x))

    def one(text):
        if text is None:
            return None
        # Words stand in the lower case of the whole text, but those past the first 50 characters are not looked for.
        words, n = [], 0
        for word in _SLUG_WORD.finditer((text if text.isascii() else _NOT_WIDE.sub(bare, text)).lower()):
            words.append(word[0])
            n += len(word[0]) + 1
            if n > 50:
                break
        return "-".join(words).replace("_", "-")[:50]

    return name.map(one)


def ascii_slug(name: Column) -> Column:
    """slug() for ASCII names, within the JVM."""
    text = F.regexp_replace(F.lower(name), r"[^0-9a-z_]", "-")
    text = F.regexp_replace(F.regexp_replace(text, "-+", "-"), "^-|-$", "")
    return F.substring(F.translate(text, "_", "-"), 1, 50)


def any_slug(name: Column) -> Column:
    """slug() of any name; only those that aren't ASCII go to Python."""
    other = name.rlike(_NOT_ASCII)
    return F.when(other, slug(F.when(other, name))).otherwise(ascii_slug(name))


def company_id(number: Column, slug_: Column) -> Column:
    return F.format_string("co:%04d-%04d:%s", F.floor(number / 10000), number % 10000, slug_)


def is_garbage(raw: Column, key: Column) -> Column:
    """Whether a scraped string is no company name. key: its normalized form."""
    digits = F.translate(key, "年月日", "")
    found = digits.rlike("^[0-9]+$") | (F.length(key) <= 1) | (raw.contains("Name:") & raw.contains("dtype"))
    for part in GARBAGE_PARTS:
        found |= raw.contains(part)
    found |= raw.rlike("|".join(GARBAGE_PATTERNS)) | F.lower(key).isin(*GARBAGE_WORDS)
    return found | ((F.length(raw) > 40) & raw.rlike(r"[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}")) | (F.length(raw) > 100)


def normalize_website(raw: Column) -> Column:
    """With a scheme, a lower-case host and no slash at the path's end; query and fragment stay; empty is null."""
    text = F.nullif(F.trim(raw), F.lit(""))
    text = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    part = lambda k: F.regexp_extract(text, r"^([^:/?#]*)://([^/?#]*)([^?#]*)(.*)$", k)
    tail = F.regexp_replace(F.regexp_replace(part(4), r"#$", ""), r"^\?(#|$)", "$1")
    made = F.concat(F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit("https")), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), tail)
    return F.when(part(2) == "", text).otherwise(made)


def extract_domain(website: Column) -> Column:
    """The last two labels of the host; empty is null."""
    host = F.regexp_replace(website, r"^.*?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(host, r"^[^/?#]*", 0)), r"^\.+", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.nullif(F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0), F.lit(""))


def normalize_stage(raw: Column) -> Column:
    key = F.lower(F.regexp_replace(raw, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    found = F.lit(None).cast("string")
    for stage, names in reversed(STAGES.items()):
        found = F.when(key.isin(*names), stage).otherwise(found)
    return found


def normalize_stages(raws: Column) -> Column:
    """Known stages of an array, each once, in their first order."""
    return F.array_distinct(F.filter(F.transform(raws, normalize_stage), lambda x: x.isNotNull()))


def nullable_text(value: Column) -> Column:
    """Any value as text; null, and a number that is none, is null."""
    return F.when(~F.coalesce(value.cast("string"), F.lit("NaN")).isin("NaN"), value.cast("string"))


def canonical_label(raw: Column, success: str, failure: str) -> Column:
    """SUCCESS and FAILURE for a configured pair of labels; any other is null."""
    return F.when(raw == success, "SUCCESS").when(raw == failure, "FAILURE")


def to_list(value: Column, is_array: bool = False) -> Column:
    """null or blank: an empty array; an array: itself; else an array of the one value."""
    if is_array:
        return F.coalesce(value, F.array().cast("array<string>"))
    return F.when(value.isNull() | (F.trim(value) == ""), F.array().cast("array<string>")).otherwise(F.array(value))


def name_from_logo(url: Column) -> Column:
    """A company's name from its logo's address: the file name without endings, years, numbers and LOGO_WORDS."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, rf"(?i)\.({'|'.join(IMAGE_ENDINGS)})$", "")
    name = lambda t: (t != "") & ~F.lower(t).isin(*LOGO_WORDS) & ~t.rlike(r"^((19|20)[0-9]{2}|[a-zA-Z]?[0-9]{6,}|[0-9]+)$")
    kept = F.array_join(F.filter(F.split(stem, "[-_]"), name), "_")
    return F.coalesce(F.nullif(kept, F.lit("")), F.nullif(stem, F.lit("")), url)


def is_url(text: Column) -> Column:
    return F.coalesce(text.startswith("http://") | text.startswith("https://") | text.startswith("/"), F.lit(False))


def round_bucket(raw: Column) -> Column:
    """The bucket of a round's name, whatever its spelling."""
    text = F.regexp_replace(identity(raw), "[_–—-]+", " ")
    text = squeeze(F.regexp_replace(text, r"\b(round|financing|funding)\b", " "))

    def bucket_of(text: Column) -> Column:
        found = F.when(text.rlike(r"bridge|extension"), "bridge_or_extension")
        found = found.when(text.rlike(r"^series? ?[a-z]( [0-9]+)?$"), F.concat(F.lit("series_"), F.regexp_extract(text, r"^series? ?([a-z])", 1))).otherwise("other")
        for bucket, names in reversed(ROUNDS.items()):
            found = F.when(text.isin(*names), bucket).otherwise(found)
        return F.when(text.isNull() | text.isin(*UNKNOWN_ROUNDS), "unknown").otherwise(found)

    # A lambda's variable holds the text, so that it is made once, not for each bucket.
    return F.transform(F.array(text), bucket_of)[0]


def hash_id(prefix: str, *parts: Column) -> Column:
    """prefix: and 20 digits of the SHA-1 of the parts joined by bars; null parts count as empty."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 20))


def record_id(version: str, event_id: Column, row_hash: Column) -> Column:
    zero = F.lit("\0")
    return F.concat(F.lit("irn:"), F.substring(F.sha2(F.concat(F.lit(version), zero, event_id, zero, row_hash), 256), 1, 24))


def id_set_sha256(ids: Column) -> Column:
    """For an aggregate: the SHA-256 of the sorted identifiers, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """{{name}} becomes the value, or <null:name> where it is null or not given."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        missing = F.lit(f"<null:{m[1]}>")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), missing) if m[1] in values else missing]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))
