"""Secret scans: three fixed patterns, and random strings found by token efficiency.

Ordinary words take few tokens of a byte-pair vocabulary, random strings take many: a
string of fewer than MOST_CHARS_PER_TOKEN characters per token is reported as ``random``.
Candidates are runs of LEAST_LENGTH or more characters of ``[A-Za-z0-9+/_=-]`` with a letter and
LEAST_DIFFERENT different characters; if one isn't random as a whole, its parts of that length between
``/``, ``=``, ``_`` and ``-`` are judged. Known digests (hexadecimal of the lengths of MD5, SHA-1, SHA-2),
UUIDs, and names put together from words by separators or a change of case are excluded.

Spans are code points with an exclusive end. ``random`` spans that touch a base span are
left out; base spans always stay, in the order of their start, then of their kind.

Defined cases: null counts as empty; texts are scanned whole; rows are judged one by one,
so repeated rows and null identifiers stay; an empty table gives an empty result; columns
other than the two named play no part.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import map_arrow

#: The base patterns, with the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

LEAST_LENGTH = 20
MOST_CHARS_PER_TOKEN = 1.9
LEAST_DIFFERENT = 6
KINDS = ("assign", "access", "hex", "random")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")  # runs are maximal, so short ones never hide long ones
_candidate = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
_uuid = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_hexadecimal = re.compile("[0-9a-fA-F]+")
#: Words of lower-case letters, maybe capitalised, or of capitals; a separator or a change from lower to upper case
#: stands between them, and numbers stand at the end of a word of four letters or more only.
_WORD = r"(?:[A-Z]?[a-z]{4,}[0-9]{1,4}(?![a-z])|[A-Z]{4,}[0-9]{1,4}(?![A-Za-z])|[A-Z]?[a-z]{3,}|[A-Z]{2,}(?![a-z]))"
_name = re.compile(rf"{_WORD}(?:(?:[_/=+-]|(?<=[a-z0-9])(?=[A-Z])){_WORD})*")
_separator = re.compile("[/=_-]+")
_KEYWORDS = ("passw", "secret", "token", "api")


def load_encoding(path: str):
    """The tiktoken encoding of a rank file; the pattern keeps a whole candidate together."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})


def is_random(candidate: str, encoding) -> bool:
    if _uuid.fullmatch(candidate):
        return False
    if _hexadecimal.fullmatch(candidate) and len(candidate) in DIGEST_LENGTHS:
        return False
    if len(candidate) >= MOST_CHARS_PER_TOKEN * len(encoding.encode_ordinary(candidate)):
        return False
    # A run of one character or two, such as a line of dashes, has nothing to hide.
    if len(set(candidate)) < LEAST_DIFFERENT or not any(map(str.isalpha, candidate)):
        return False
    # Only what is put together from several words is a name: a single run of letters is left to the tokens.
    return not (_name.fullmatch(candidate) and (_separator.search(candidate) or re.search("[a-z0-9][A-Z]", candidate)))


def random_parts(candidate: str, encoding) -> list[tuple[int, int]]:
    """The random strings of a candidate: itself, or its long parts between separators."""
    whole = candidate.rstrip("=")
    if is_random(whole, encoding):
        return [(0, len(candidate))]
    if _uuid.fullmatch(whole):
        return []
    found, start = [], 0
    for m in [*_separator.finditer(candidate), None]:
        end = m.start() if m else len(candidate)
        if LEAST_LENGTH <= end - start < len(whole) and is_random(candidate[start:end], encoding):
            found.append((start, end))
        start = m.end() if m else end
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, end) of the three fixed patterns."""
    found = []
    folded = text.lower()
    if any(word in folded for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list, encoding) -> list[tuple[int, int, str]]:
    found, at, reach = [], 0, 0  # reach: the furthest end of the base spans that begin before the candidate ends
    for m in _candidate.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            found += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m[0], encoding)]
    return found


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) structs, the base kinds among them.

    ranks_path: a tiktoken rank file that every executor can open.
    """
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        encoding = None
        for batch in batches:
            encoding = encoding or load_encoding(ranks_path)
            spans = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base + random_spans(text, base, encoding))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind_type)], ["doc_id", "spans"])

    return map_arrow(rows, run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from what scan() returns."""

    def text_of(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    def n(kind: str) -> str:
        return f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)"

    base = "filter(spans, s -> s.kind <> 'random')"
    return scanned.selectExpr(
        "doc_id",
        f"{n('assign')} AS n_assign",
        f"{n('access')} AS n_access",
        f"{n('hex')} AS n_hex",
        f"{n('random')} AS n_random",
        f"sha2({text_of(base)}, 256) AS base_sha256",
        f"{text_of('spans')} AS spans",
    )
