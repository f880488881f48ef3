"""Line-first quality rules.

Every line is judged on its own before the document is: lines that look like navigation,
boilerplate or unpunctuated fragments are removed, and a document is then rejected when
cleaning took too much of its text. Two document-level base rules come first: too few
words, and too many words inside repeated three-word windows.

Words are runs of characters other than a space and 09 to 0D. Lines are what "\\n" splits.

A line with at least one word fails a rule as follows.

* navigation: at least two separators (``|``, ``>``, ``»`` or ``•`` standing alone as a
  word), which are at least NAV_LEAST_PERCENT of its words;
* boilerplate: it contains one of the fixed phrases, ASCII letters in either case;
* punctuation: at least PUNCT_LEAST_WORDS words and no character of ``.,;:!?`` at all, or
  more than PUNCT_MOST_PERCENT of its characters that are not white space are symbols.

The verdict: a document loses its failing lines, and is rejected when more than
LOST_MOST_PERCENT of its word characters go with them.

Defined cases: null text is a text without words (rejected, all counts 0); an empty table
gives an empty result; rows are judged one by one, so repeated rows and null identifiers
stay as they are; columns of the input other than the two named play no part.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import map_arrow

#: Thresholds of the base rules, in words and per cent of words.
LEAST_WORDS = 50
REPEAT_MOST_PERCENT = 50
#: Thresholds of the line rules and of the verdict.
NAV_LEAST_PERCENT = 15
PUNCT_LEAST_WORDS = 30
PUNCT_MOST_PERCENT = 12
LOST_MOST_PERCENT = 50

#: Characters counted as symbols, and characters that punctuate a sentence.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?"
#: Characters that separate entries of a menu, with spaces around them or not, and a word that does.
SEPARATORS, SEPARATING_WORD = "|»•", ">"
#: Phrases of boilerplate lines, in English, German, French and Spanish; letters with accents are left out.
PHRASES = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "privacy policy",
    "skip to content",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "allgemeine nutzungsbedingungen",
    "newsletter abonnieren",
    "zum inhalt springen",
    "accepter tous les cookies",
    "aller au contenu",
    "politique de confidentialit",
    "abonnez-vous ",
    "aceptar todas las cookies",
    "de privacidad y cookies",
    "ir al contenido",
    "todos los derechos reservados",
)

_BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)), re.ASCII | re.IGNORECASE)
_WORDS = re.compile("[^ \t-\r]+").findall
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bad_lines long, lost_chars long, kept boolean, clean_text string"


def n_word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in " \t\n\v\f\r")


def repeated_words(words: list) -> int:
    """Words inside a three-word window that occurs twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside, last = 0, -1  # last: the last word counted so far
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside += i + 2 - max(last, i - 1)
            last = i + 2
    return inside


def line_fails(line: str, words: list[str], chars: int) -> bool:
    """chars: the line's word characters, at least 1."""
    separators = sum(map(line.count, SEPARATORS)) + words.count(SEPARATING_WORD)
    if separators >= 2 and 100 * separators >= NAV_LEAST_PERCENT * len(words):
        return True
    if len(words) >= PUNCT_LEAST_WORDS and not any(c in line for c in PUNCTUATION):
        return True
    if 100 * sum(map(line.count, SYMBOLS)) > PUNCT_MOST_PERCENT * chars:
        return True
    return _BOILERPLATE.search(line) is not None


def judge(text: str | None) -> tuple:
    """The counts, verdicts and cleaned text of one document, in the order of the schema."""
    text = text or ""
    words = text.encode().split()
    chars = n_word_chars(text)
    seen, dup, kept_lines, bad, lost = set(), 0, [], 0, 0
    for line in text.split("\n"):
        in_line = _WORDS(line)
        if not in_line:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        line_chars = sum(map(len, in_line))
        if line_fails(line, in_line, line_chars):
            bad += 1
            lost += line_chars
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeat > REPEAT_MOST_PERCENT * len(words)
    kept = not failed and 100 * lost <= LOST_MOST_PERCENT * chars
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, dup, repeat, failed, bad, lost, kept, "\n".join(kept_lines)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept and clean_text (the text without failing lines)."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = list(zip(*map(judge, batch.column("text").to_pylist()))) or [[]] * 10
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.bool_(), pa.string()]
            columns = [pa.array(x, t) for x, t in zip(found, types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))])

    return map_arrow(rows, run, f"doc_id {id_type}, {_SCHEMA}")


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The kept documents without their failing lines, in the columns of ``docs``; rejected ones go.

    Verdicts are made in the pass that carries the rows, so nothing is joined. A text that
    lost lines has its length in ``chars_col`` set anew, where there is such a column.
    """
    at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            verdicts = [judge(x) for x in texts]
            columns = list(batch.columns)
            columns[at] = pa.array([v[9] if v[6] else x for v, x in zip(verdicts, texts)], batch.schema.field(at).type)
            if chars_at is not None:
                counts = columns[chars_at].to_pylist()
                columns[chars_at] = pa.array([len(v[9]) if v[6] else n for v, n in zip(verdicts, counts)], batch.schema.field(chars_at).type)
            made = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield made.filter(pa.array([v[8] for v in verdicts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def oracle() -> str:
    """DuckDB SQL for quality(), without clean_text."""
    words = r"'[^\x20\x09-\x0D]+'"
    symbols = "[" + SYMBOLS + "]"
    phrases = "|".join(PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {words}) AS words FROM documents),
lines AS (SELECT doc_id, line, regexp_extract_all(line, {words}) AS words
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
worded AS (SELECT doc_id, line, words, length(array_to_string(words, '')) AS chars,
           row_number() OVER (PARTITION BY doc_id, line) AS nth FROM lines WHERE len(words) > 0),
judged AS (SELECT doc_id, chars, nth,
           (len(list_filter(words, lambda w: w = '{SEPARATING_WORD}')) + length(line) - length(regexp_replace(line, '[{SEPARATORS}]', '', 'g')) >= greatest(2, {NAV_LEAST_PERCENT} * len(words) / 100.0))
           OR (len(words) >= {PUNCT_LEAST_WORDS} AND NOT regexp_matches(line, '[{PUNCTUATION}]'))
           OR 100 * (length(line) - length(regexp_replace(line, '{symbols}', '', 'g'))) > {PUNCT_MOST_PERCENT} * chars
           OR regexp_matches(line, '(?i){phrases}') AS bad FROM worded),
by_doc AS (SELECT doc_id, sum(chars)::BIGINT AS word_chars, count(*) FILTER (nth > 1) AS n_dup_lines,
           count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(chars) FILTER (bad), 0)::BIGINT AS lost_chars FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, i, words[i:i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
counts AS (SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.word_chars, 0) AS word_chars,
           (length(d.text) - length(regexp_replace(d.text, '{symbols}', '', 'g')))::BIGINT AS n_symbols,
           coalesce(b.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
           coalesce(b.n_bad_lines, 0) AS n_bad_lines, coalesce(b.lost_chars, 0) AS lost_chars
           FROM d LEFT JOIN by_doc b USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
base AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_MOST_PERCENT} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND 100 * lost_chars <= {LOST_MOST_PERCENT} * word_chars AS kept FROM base
"""
