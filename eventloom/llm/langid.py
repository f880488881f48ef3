"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased text, hashed into N_BUCKETS; what
is not a letter counts as a space, and runs of spaces count once. Training gives a matrix
of log-probabilities (languages x buckets), whose size is fixed by the number of languages
(MOST_LANGUAGES at most) and N_BUCKETS, so it is broadcast. Scoring is sparse: the hashed
n-grams of many texts lie in one flat array with row offsets, and numpy sums the matrix
columns they name between the offsets.

Only the training reads a sample, and only of labelled rows: per language, rows are taken
whose hashed identifier is under a threshold that leaves about TRAIN_ROWS of them. Since
that makes the languages about equal in the sample, their shares there say nothing, and
priors are uniform. All texts are scored whole, in pieces of bounded size.

Defined cases: a text that is null or has no letter is ``und`` with score 0; languages
that tie go to the first in byte order; an empty table gives an empty result; without any
labelled row every text is ``und``; columns other than the named ones play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_arrow

N_BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 1000
#: About so many labelled rows of each language are learned from.
TRAIN_ROWS = 3000
SMOOTHING = 0.5
#: Characters scored at once.
PIECE = 1 << 20
UND = "und"

_letters = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, one space (32) for each run of what is not a letter, and at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[raw]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    points = np.full(len(raw) + 2, 32, np.uint32)
    points[1:-1] = np.where(is_letter, raw, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def buckets(points: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Hashed n-grams of all ORDERS that begin at the first ``starts`` places (None: at all); those that cross the end are left out."""
    n = len(points)
    mixed = points * np.uint32(0x9E3779B1)
    found = np.full((len(ORDERS), n), -1, np.int32)
    gram = np.zeros(n + 1, np.uint32)
    for k, order in enumerate(ORDERS):
        if n < order:
            break
        # gram[i]: the hash of the n-gram that starts at i
        gram = gram[: n - order + 1] * np.uint32(0x85EBCA6B) + mixed[order - 1 :]
        spread = (gram ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE35) + np.uint32(order * 0x27D4EB2F % (1 << 32))
        found[k, : n - order + 1] = spread >> np.uint32(32 - N_BUCKETS.bit_length() + 1)
    found = found[:, :starts]
    flat = found.T.ravel()
    return flat[flat >= 0]


def pieces(texts: list):
    """(row, hashed n-grams) of the texts with letters; long texts come in pieces, which look ahead for n-grams that cross their ends."""
    for row, text in enumerate(texts):
        points = code_points(text) if text else ()
        for at in range(0, len(points), PIECE):
            yield row, buckets(points[at : at + PIECE + max(ORDERS) - 1], PIECE)


def score_batch(texts: list, log_prob: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint log-probabilities (texts x languages) and the number of n-grams of each text."""
    total = np.tile(prior, (len(texts), 1))
    count = np.zeros(len(texts), np.int64)
    rows, waiting, size = [], [], 0

    def settle():
        offsets = np.cumsum([0] + [len(x) for x in waiting[:-1]])
        flat = np.concatenate(waiting)
        for k in range(log_prob.shape[0]):
            np.add.at(total[:, k], rows, np.add.reduceat(log_prob[k][flat], offsets))
        np.add.at(count, rows, [len(x) for x in waiting])
        rows.clear()
        waiting.clear()

    for row, found in pieces(texts):
        rows.append(row)
        waiting.append(found)
        size += len(found)
        if size >= PIECE:
            settle()
            size = 0
    if waiting:
        settle()
    return total, count


def train_rows(docs: DataFrame, id_col: str, lang_col: str, held_out) -> DataFrame:
    """The sample of labelled rows that the model learns from."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    counts = labelled.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    keep = F.lit(False)
    point = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000))
    for lang, n in counts:
        keep = keep | ((F.col(lang_col) == lang) & (point < int(1_000_000 * min(1.0, TRAIN_ROWS / n)) + 1))
    return labelled.filter(keep)


def fit(rows: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in byte order, log-probabilities (languages x N_BUCKETS), log-priors (uniform).

    Each task sends one row of counts for each language it met, as bytes of fixed length.
    """

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, found in pieces(batch.column(0).to_pylist()):
                mine = held.setdefault(langs[row], np.zeros(N_BUCKETS, np.int64))
                mine += np.bincount(found, minlength=N_BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": counts[at]})

    counted = map_arrow(rows.select(text_col, lang_col), count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted({x for x in table.column("lang").unique().to_pylist()})
    counts = np.zeros((len(langs), N_BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        where = np.array([place[x] for x in table.column("lang").to_pylist()])
        counts[where, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    smooth = counts + SMOOTHING
    log_prob = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if langs else counts
    return langs, log_prob.astype(np.float32), np.zeros(len(langs))


def predict(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the posterior of the language)."""
    langs, log_prob, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, log_prob, prior))
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        langs, log_prob, prior = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not langs:
                best, score = [UND] * len(texts), [0.0] * len(texts)
            else:
                joint, count = score_batch(texts, log_prob, prior)
                top = joint.argmax(axis=1)
                odds = np.exp(joint - joint.max(axis=1, keepdims=True))
                post = 1.0 / odds.sum(axis=1)
                best = [langs[k] if n else UND for k, n in zip(top, count)]
                score = np.where(count > 0, post, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(rows, run, f"doc_id {id_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the identifier's text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    model = fit(train_rows(docs, id_col, lang_col, held_out(id_col)), text_col, lang_col)
    made = predict(docs, model, id_col, text_col)
    return made.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
