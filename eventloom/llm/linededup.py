"""Line deduplication with content-defined chunks of lines, and windows of LONG_WORDS words.

A document's lines are hashed; a rolling hash over the hashes of the last WINDOW lines
chooses where a chunk ends, so the same run of lines is cut alike wherever it stands. A
line of LONG_WORDS words or more is a chunk of its own: the lines around it differ from
document to document. Chunks of two lines with words or more, or with LONG_WORDS words,
count.

Chunks alone miss a passage in which no two places end a chunk. So from each line with words
the shortest run of lines that has LONG_WORDS words counts as well, and so does the shortest
one that ends with the line. Each shared run of whole lines with LONG_WORDS words or more is
covered by such windows in full, wherever it stands.

Of a chunk or window that occurs again anywhere, the first occurrence (smallest document,
then place) stays, all others are removed, but for those that overlap the first one in its
own document. Windows overlap: a first occurrence can lose lines to a passage that occurs
still earlier, so each removed line, not each passage, stays at an earlier place.

Occurrences meet by the SHA-256 of their lines' SHA-256s; they are summed up on the map side
first, so a chunk that is everywhere costs a row for each task. Before anything is removed,
its text is fetched from its document and compared byte for byte with that of the place
that stays.

A document is an identifier with a text: rows that share an identifier, or have none, are
judged by their own texts, and only rows that share both count as one document, in which
the same places stay and go.

Defined cases: null text has no lines; a text of any length is cut whole, a chunk has
MOST_LINES lines at most (a window has no such limit); rows without an identifier are never
the first unless there is no other; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, map_arrow, materialize

WINDOW = 3
#: One in so many places between short lines ends a chunk.
DIVISOR = 3
LONG_WORDS = 50
MOST_LINES = 64

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15


def n_words(line: str) -> int:
    return len(line.encode("utf-8", "surrogatepass").split())


def windows(counts: list[int]) -> set[tuple[int, int, int]]:
    """(first line, line after the last, words) of the shortest runs of LONG_WORDS words from each line with words, and up to each."""
    found = set()
    after = words = 0
    for first, n in enumerate(counts):  # words: of the lines from first up to after
        while words < LONG_WORDS and after < len(counts):
            words += counts[after]
            after += 1
        if words < LONG_WORDS:
            break
        if n:
            found.add((first, after, words))
        words -= n
    first = words = 0
    for last, n in enumerate(counts):
        words += n
        while words - counts[first] >= LONG_WORDS or first < last and not counts[first]:
            words -= counts[first]
            first += 1
        if n and words >= LONG_WORDS:
            found.add((first, last + 1, words))
    return found


def cut(lines: list[str]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, words) of each chunk and window, in the order of their places."""
    counts = [n_words(line) for line in lines]
    found, start, words, recent = windows(counts), 0, 0, []
    for i, (line, n) in enumerate(zip(lines, counts)):
        if n >= LONG_WORDS:
            if start < i:
                found.add((start, i, words))
            found.add((i, i + 1, n))
            start, words, recent = i + 1, 0, []
            continue
        words += n
        recent = [*recent[1 - WINDOW :], xxhash.xxh3_64_intdigest(line)]
        rolling = 0
        for h in recent:
            rolling = (rolling * _FACTOR + h) & _MASK
        if (rolling >> 32) % DIVISOR == 0 or i + 1 - start >= MOST_LINES:
            found.add((start, i + 1, words))
            start, words = i + 1, 0
    if start < len(lines):
        found.add((start, len(lines), words))
    return sorted(found)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of the document: identifier and text), text."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.sha2(F.col(text_col), 256))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks and windows that count: doc_id, key, chunk (its number), first, after, words, sha; and a row (chunk -1) for each document, with the words of its lines."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            at, made = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                lines = text.split("\n") if text is not None else []
                counts = [n_words(line) for line in lines]
                shas = [hashlib.sha256(line.encode("utf-8", "surrogatepass")).digest() for line in lines]
                cuts = cut(lines)
                at.append(row)
                made.append((-1, len(lines), len(cuts), 0, None, counts))
                for k, (first, after, words) in enumerate(cuts):
                    if words >= LONG_WORDS or words and sum(map(bool, counts[first:after])) >= 2:
                        at.append(row)
                        made.append((k, first, after, words, hashlib.sha256(b"".join(shas[first:after])).digest(), None))
            columns = [pa.array(x, t) for x, t in zip(zip(*made), types)]
            of = [batch.column(c).take(pa.array(at, pa.int32())) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*of, *columns], ["doc_id", "key", "chunk", "first", "after", "words", "sha", "line_words"])

    return map_arrow(rows, run, f"doc_id {id_type}, key long, chunk long, first long, after long, words long, sha binary, line_words array<long>")


def _texts_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The texts of places: sha, first, after, stays, doc_id, key, text. places: doc_id, key, sha, first, after, stays."""
    spans = F.collect_set(F.struct("sha", "first", "after", "stays")).alias("spans")
    wanted = places.groupBy(F.col("key").alias("of"), F.col("doc_id").alias("of_id")).agg(spans)
    joined = rows.join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("doc_id", "key", "text", "spans")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, made = [], []
            for row, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                lines = text.split("\n")
                for s in spans:
                    at.append(row)
                    made.append((s["sha"], s["first"], s["after"], s["stays"], "\n".join(lines[s["first"] : s["after"]])))
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
            of = [batch.column(c).take(pa.array(at, pa.int32())) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([*of, *columns], ["doc_id", "key", "sha", "first", "after", "stays", "text"])

    return map_arrow(joined, run, f"doc_id {id_type}, key long, sha binary, first long, after long, stays boolean, text string")


#: Overlapping and touching spans of a sorted array, as one each.
_MERGED = """aggregate({0}, CAST(array() AS array<struct<first:bigint,after:bigint>>), (m, s) -> CASE
  WHEN size(m) > 0 AND element_at(m, -1).after >= s.first
  THEN concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'after', greatest(element_at(m, -1).after, s.after))))
  ELSE concat(m, array(named_struct('first', s.first, 'after', s.after))) END)"""


def _judged(rows: DataFrame) -> DataFrame:
    """What repeated() returns, with the document's key."""
    chunks = materialize(_chunks(rows), "chunks")
    narrow = chunks.filter("chunk >= 0").drop("chunk", "words", "line_words")
    # Documents in order: those with an identifier first.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    texts = narrow.groupBy("sha").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n"))
    texts = materialize(texts.filter("n > 1").drop("n"), "texts")
    # Written step by step, so that nothing but a join stands above its exchanges and Spark may split a chunk that is everywhere.
    places = materialize(narrow.join(texts, "sha"), "places")
    own = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("key") == F.col("keep.key"))
    first = materialize(places.filter(own).groupBy("sha").agg(F.min("first").alias("keep_first")), "first")
    kept = own & (F.col("first") < F.col("keep_first") + F.col("after") - F.col("first"))
    same = materialize(places.join(first, "sha").filter(~kept).select("doc_id", "key", "first", "after", "sha"), "same")
    stays = places.join(first, "sha").filter(own & (F.col("first") == F.col("keep_first"))).join(same.select("sha").distinct(), "sha", "left_semi")
    both = same.withColumn("stays", F.lit(False)).unionByName(stays.select("doc_id", "key", "first", "after", "sha", F.lit(True).alias("stays")))
    found = materialize(_texts_of(rows, both.distinct()), "found")
    kept_text = found.filter("stays").groupBy("sha").agg(F.min("text").alias("kept_text"))
    # Byte for byte: equal hashes alone remove nothing.
    gone = found.filter(~F.col("stays")).join(kept_text, "sha").filter(F.col("text") == F.col("kept_text")).select("doc_id", "key", "first", "after")
    whole = chunks.filter("chunk = -1").select("doc_id", "key", F.col("first").alias("n_lines"), F.col("after").alias("n_chunks"), "line_words")
    spans = F.array_sort(F.collect_set(F.struct("first", "after")))
    by_doc = gone.groupBy(F.col("key").alias("of"), F.col("doc_id").alias("of_id")).agg(F.count(F.lit(1)).alias("n_removed"), spans.alias("removed"))
    joined = whole.join(by_doc, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
    words = F.expr(f"aggregate({_MERGED.format('removed')}, 0L, (n, s) -> n + aggregate(slice(line_words, int(s.first) + 1, int(s.after - s.first)), 0L, (a, b) -> a + b))")
    none = F.expr("CAST(array() AS array<struct<first:bigint,after:bigint>>)")
    discard(texts, places, first, same)
    return joined.select("doc_id", "key", "n_lines", "n_chunks", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(words, F.lit(0)).alias("removed_words"), F.coalesce("removed", none).alias("removed"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_chunks, n_removed, removed_words, removed.

    n_chunks and n_removed count chunks and windows, which overlap; removed_words counts each removed line once.
    removed: the removed line ranges as an array of (first, after) structs, lines counted from 0.
    """
    return _judged(_keyed(docs, id_col, text_col)).drop("key")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their own columns, without the removed lines."""
    rows = _keyed(docs, id_col, text_col)
    spans = _judged(rows).filter("n_removed > 0").select("key", "doc_id", F.expr(_MERGED.format("removed")).alias("removed")).dropDuplicates(["key", "doc_id"])
    # The columns of the documents travel as one, so that no name of theirs meets one of ours.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("of_id"), F.xxhash64(F.col(id_col).cast("string"), F.sha2(F.col(text_col), 256)).alias("of"))
    joined = whole.join(spans, (F.col("of") == F.col("key")) & F.col("of_id").eqNullSafe(F.col("doc_id")), "left")
    text = F.col(f"whole.`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.exists(F.col("removed"), lambda r: (i >= r["first"]) & (i < r["after"])))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return joined.select(*[cleaned if c == text_col else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
