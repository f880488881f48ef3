"""Ranked lexical search: WAND over an index that is sharded by document.

Three passes. The first reads the documents once and writes shards to the shared folder: for
some thousand documents, the postings of the terms that any query asks for, with lengths.
The second adds up what all shards say (documents, terms, documents of each term). The
third runs WAND in each shard: cursors stand in the order of their documents, the pivot is
the first document at which the sum of the terms' largest impacts reaches what the worst of
the k best has, cursors before it leap there by binary search, and only a pivot that all
cursors before it have reached is scored. The k best go from shard to shard within a task;
what tasks return is merged by rank.

A shard's threshold doesn't start at nothing: where a term has k postings, the k-th largest
impact of that term alone is a score that k documents have at least.

Queries come in blocks of at most BLOCK_TERMS different terms (or of one query, if that has
more), so that what tasks get is bounded, whatever the number of queries. Terms are
compared as bytes of UTF-8; separators are ASCII only, so words never need decoding.

Defined cases: null and empty texts have no term, and neither rank nor count; a query
without terms, or whose terms are in no document, has no rows; each row of the queries is
one query, and each row of the documents one document, also where identifiers repeat;
equal scores go by ascending identifier, null last; an empty table on either side gives an
empty result; columns other than the named ones play no part. Identifiers of documents are
whole numbers.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import map_arrow, materialize

TOP = 50
#: Different terms of a block of queries, and bytes of text that are cut into words at once.
BLOCK_TERMS = 200_000
PIECE = 1 << 20
#: A shard ends with the document that brings it to so many postings.
SHARD_POSTINGS = 1 << 20
LONGEST = (1 << 63) - 1

#: A-Z become a-z, other ASCII characters than letters and digits become spaces, the rest stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None):
    """Lists of a text's terms, a piece of bounded length at a time (a longer term stays whole)."""
    folded, at = (text or b"").translate(FOLD), 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        found = folded[at:end].split()
        if found:
            yield found
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per query: its number, its identifier and its different terms, written once so that numbers stay."""
    rows = items.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            terms = [sorted({w for part in words(text) for w in part}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["no", "item_id", "terms"])

    return materialize(map_arrow(rows, run, f"no long, item_id {id_type}, terms array<binary>"), "queries")


def blocks(queries: DataFrame):
    """Blocks of queries as ({term: number}, {query: [term numbers]}); the driver holds one block at a time."""
    known: dict[bytes, int] = {}
    held: dict[int, list[int]] = {}
    for no, terms in queries.select("no", "terms").filter(F.size("terms") > 0).toLocalIterator():
        if held and len(known) + len(terms) > BLOCK_TERMS:
            yield known, held
            known, held = {}, {}
        held[no] = [known.setdefault(bytes(t), len(known)) for t in terms]
    if held:
        yield known, held


SHARD = "n_docs long, n_terms long, doc_ids array<bigint>, lengths array<bigint>, terms array<int>, dfs array<int>, places binary, tfs binary"


def index(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Shards of documents (SHARD): numbers of documents and terms, and postings of the known terms.

    Postings lie one term after the other in places and tfs (int32), dfs of them for each of
    terms; places count the shard's documents that hold a known term.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        get = shared.value.get
        n_docs = n_terms = held = 0
        ids, lengths, found, counts = [], [], [], []

        def shard():
            term = np.concatenate(found) if found else np.empty(0, np.int32)
            place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in found])
            order = np.argsort(term, kind="stable")
            terms, dfs = np.unique(term, return_counts=True)
            tf = np.concatenate(counts) if counts else term
            values = [[n_docs], [n_terms], [ids], [lengths], [terms], [dfs], [place[order].tobytes()], [tf[order].astype(np.int32).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], [x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                length, mine = 0, []
                for part in words(text):
                    length += len(part)
                    mine += [k for k in map(get, part) if k is not None]
                if length:
                    n_docs += 1
                    n_terms += length
                if mine:
                    term, count = np.unique(np.array(mine, np.int32), return_counts=True)
                    ids.append(doc_id)
                    lengths.append(length)
                    found.append(term)
                    counts.append(count)
                    held += len(term)
                if held >= SHARD_POSTINGS:
                    yield shard()
                    n_docs = n_terms = held = 0
                    ids, lengths, found, counts = [], [], [], []
        if n_docs:
            yield shard()

    return map_arrow(rows, run, SHARD)


class Shard:
    """Postings of one shard with their impacts, by term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weights: dict[int, int], top: int):
        self.doc_ids = row["doc_ids"]
        longest = max(row["lengths"], default=0)
        kind = np.int64 if 50 * longest * n_docs <= LONGEST else object
        m = 50 + (50 * np.array(row["lengths"], kind) * n_docs) // n_terms
        places, tfs = np.frombuffer(row["places"], np.int32), np.frombuffer(row["tfs"], np.int32)
        self.postings, at = {}, 0
        for term, df in zip(row["terms"], row["dfs"]):
            if w := weights[term]:
                place, tf = places[at : at + df], tfs[at : at + df].astype(np.int64)
                impact = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
                sure = int(np.partition(impact, df - top)[df - top]) if df >= top else 0
                self.postings[term] = (place.tolist(), impact.tolist(), int(impact.max()), sure)
            at += df


def wand(shard: Shard, terms: list[int], best: list, top: int) -> int:
    """Update ``best``, a heap of (score, -doc_id), with the shard's documents; the number of documents scored."""
    lists = [shard.postings[t] for t in terms if t in shard.postings]
    places, impacts, most = [x[0] for x in lists], [x[1] for x in lists], [x[2] for x in lists]
    at = [0] * len(lists)
    least = max([1, *(x[3] for x in lists), *(best[0][:1] if len(best) == top else ())])
    scored = 0
    order = sorted((place[0], t) for t, place in enumerate(places))
    while order:
        reach, pivot = 0, -1
        for place, t in order:
            reach += most[t]
            if reach >= least:
                pivot = place
                break
        if pivot < 0:
            break
        moved = 0
        if order[0][0] == pivot:
            score = 0
            for place, t in order:
                if place != pivot:
                    break
                k = at[t]
                score += impacts[t][k]
                at[t] = k + 1
                order[moved] = (places[t][k + 1], t) if k + 1 < len(places[t]) else None
                moved += 1
            scored += 1
            if score >= least:
                doc_id = shard.doc_ids[pivot]
                entry = (score, -doc_id if doc_id is not None else -(1 << 63))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == top:
                    least = max(least, best[0][0])
        else:
            for place, t in order:
                if place >= pivot:
                    break
                k = at[t] = bisect_left(places[t], pivot, at[t] + 1)
                order[moved] = (places[t][k], t) if k < len(places[t]) else None
                moved += 1
        if None in order[:moved]:
            order = [x for x in order if x is not None]
        order.sort()
    return scored


def _ranked(shards: DataFrame, queries: dict[int, list[int]], weights: dict[int, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """no, doc_id, score of the best of each task's shards."""
    shared = shards.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0], n_docs, n_terms, weights, top)
                for no, terms in queries.items():
                    wand(shard, terms, best.setdefault(no, []), top)
        rows = [(no, None if d == -(1 << 63) else -d, score) for no, heap in best.items() for score, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["no", "doc_id", "score"])

    return map_arrow(shards.drop("n_docs", "n_terms"), run, "no long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per query its ``top`` documents with the highest scores over 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    queries = query_rows(items, item_col, item_text_col)
    found = []
    for known, asked in blocks(queries):
        shards = materialize(index(docs, known, id_col, text_col), "shards")
        n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        counted = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect()
        weights = {term: weight(n_docs, df) for term, df in counted}
        found.append(_ranked(shards, asked, weights, n_docs, n_terms, top))
    if not found:
        found = [spark.createDataFrame([], "no long, doc_id long, score long")]
    every = reduce(DataFrame.unionAll, found)
    place = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = every.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(queries.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")


#: The contract in SQL: every document is scored for every item.
ORACLE = f"""WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
terms AS MATERIALIZED (
  SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM folded WHERE t IS NOT NULL),
lengths AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM lengths),
sized AS (SELECT r, doc_id, 50 + ((50 * n * docs) // l) AS m FROM lengths, whole),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM terms GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, whole),
asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
scored AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN sized USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""
