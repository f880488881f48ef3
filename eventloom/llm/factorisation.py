"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its words, hashed into N_WORDS buckets and scaled to length one, and
one bin for each of FIELDS: shares that describe its structure (symbols, capitals, repeated
neighbours, repeated lines, ...), its size, and the table's n_chars as metadata. The score is

    w0 + Σ w_i x_i + ½ Σ_f [ (Σ_i v_if x_i)² - Σ_i v_if² x_i² ]

so all pairs of features interact through RANK factors, in time linear in the features.
Words are found and hashed in numpy, many texts at a time: with prefix sums of b_j P^j modulo
2^64, the hash of any range of bytes is a difference times a power of 1/P.

The fit (Adagrad on the logistic loss) reads a sample of labelled rows only, and only of those
that aren't held out: of each label, about TRAIN_ROWS documents, whose hashed identifier is
under a threshold. A document has N_WORDS + len(FIELDS) features at most, so the driver
holds a bounded number of them. The labels' true shares come back as an offset. All texts are
scored whole, PIECE bytes at a time.

Defined cases: a null text is an empty one, and has the size's, and the metadata's, features
only; a missing or null n_chars has a bin of its own; documents with several labels that
differ, and labels other than 0 and 1, aren't learned from; without any labelled row every
score is 0.5; of labelled rows that share an identifier the smallest text is learned from;
an empty table gives an empty result; columns other than the named ones play no part. A line
or word longer than PIECE counts as several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_arrow

N_WORDS = 1 << 12
BINS = 16
RANK = 8
#: About so many labelled documents of each label are learned from.
TRAIN_ROWS = 3000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 1e-5
PIECE = 1 << 20

FIELDS = ("words", "word_length", "symbols", "exclamations", "capitals", "digits", "periods", "neighbours", "different", "lines", "repeated_lines", "plain_ends", "metadata")
N_FEATURES = N_WORDS + len(FIELDS) * BINS

_PRIME = 0x9E3779B97F4A7C15
_powers = None


def _classes() -> np.ndarray:
    """For each byte: 1 white space, 2 symbol, 4 exclamation or question mark, 8 capital, 16 digit, 32 period, comma or the like."""
    kind = np.zeros(256, np.uint8)
    for bit, chars in ((1, b" \t\n\x0b\x0c\r"), (2, b"#*$%&|<>"), (4, b"!?"), (8, bytes(range(65, 91))), (16, b"0123456789"), (32, b".,;:")):
        kind[list(chars)] |= bit
    return kind


CLASSES = _classes()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """P^j and P^-j modulo 2^64, for places inside a piece."""
    global _powers
    if _powers is None:
        n = 2 * PIECE + 2
        both = []
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = tuple(both)
    return _powers


def pieces(texts: list):
    """Groups of texts, as ([row of each part], [parts]): at most PIECE bytes each; a longer text in parts, cut at a line's end or a word's where there is one."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + PIECE, len(text))
            if end < len(text):
                for mark in (b"\n", b" "):
                    found = text.rfind(mark, at, end)
                    if found > at:
                        end = found + 1
                        break
            if size + end - at > PIECE and parts:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(text[at:end])
            size += end - at
            at = end
    if parts:
        yield rows, parts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _survey(rows: list, parts: list, counts: np.ndarray, buckets: list, lines: list) -> None:
    """Add one group's counts to the rows' (see COUNTED); append (row, bucket) of words and (row, hash) of lines."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = CLASSES[raw]
    rows = np.array(rows)
    ends = np.cumsum([len(p) + 1 for p in parts])
    forth, back = powers()
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((LOWER[raw] + np.uint64(1)) * forth[: len(raw)], out=prefix[1:])

    def hashed(a, b):
        return _mixed((prefix[b] - prefix[a]) * back[a])

    blank = kind & 1 > 0
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    owner = np.searchsorted(ends, start, side="right")
    words = hashed(start, end)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    np.add.at(counts[:, 0], rows[owner], 1)
    np.add.at(counts[:, 1], rows[owner], end - start)
    np.add.at(counts[:, 2], rows[owner], again)
    for column, bit in ((3, 2), (4, 4), (5, 8), (6, 16), (7, 32)):
        np.add.at(counts[:, column], rows[np.searchsorted(ends, np.flatnonzero(kind & bit), side="right")], 1)
    # Lines with a word: from the first word after a line's end to the end of its last one.
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, start)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.append(first[1:], len(start)) - 1
    if len(first):
        np.add.at(counts[:, 8], rows[owner[first]], 1)
        np.add.at(counts[:, 9], rows[owner[first]], (kind[end[last] - 1] & (4 | 32)) == 0)
        lines.append((rows[owner[first]], hashed(start[first], end[last])))
    buckets.append((rows[owner], (words >> np.uint64(64 - N_WORDS.bit_length() + 1)).astype(np.int64)))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of a share by its logarithm: bin 0 for none, then 1/8192 and less up to 1 and more."""
    ratio = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(np.floor(np.log2(np.maximum(ratio, 1e-9))) + BINS - 2, 1, BINS - 1), 0).astype(np.int64)


def _size(n: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log2(n + 1)), 0, BINS - 2).astype(np.int64)


def features(texts: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of texts (bytes or null): offsets (one more than texts), indices, values."""
    texts = [t or b"" for t in texts]
    n = len(texts)
    counts = np.zeros((n, 10), np.int64)
    buckets, lines = [], []
    for rows, parts in pieces(texts):
        _survey(rows, parts, counts, buckets, lines)
    empty = np.empty(0, np.int64)
    row = np.concatenate([x[0] for x in buckets]) if buckets else empty
    bucket = np.concatenate([x[1] for x in buckets]) if buckets else empty
    code, times = np.unique(row * N_WORDS + bucket, return_counts=True)
    row, bucket = code // N_WORDS, code % N_WORDS
    value = np.sqrt(times)
    value /= np.sqrt(np.bincount(row, times, n))[row]
    repeated = np.zeros(n, np.int64)
    if lines:
        owner, digest = np.concatenate([x[0] for x in lines]), np.concatenate([x[1] for x in lines])
        order = np.lexsort((digest, owner))
        owner, digest = owner[order], digest[order]
        same = (owner[1:] == owner[:-1]) & (digest[1:] == digest[:-1])
        np.add.at(repeated, owner[1:][same], 1)
    words, chars, again, symbols, marks, capitals, digits, periods, n_lines, plain = counts.T
    told = np.array([-1 if x is None else max(x, 0) for x in n_chars], np.float64)
    bins = np.stack(
        [
            _size(words), np.clip(chars // np.maximum(words, 1), 0, BINS - 1), _share(symbols, words), _share(marks, words), _share(capitals, chars), _share(digits, chars), _share(periods, words),
            _share(again, words), _share(np.bincount(row, minlength=n), words), _size(n_lines), _share(repeated, n_lines), _share(plain, n_lines), np.where(told < 0, BINS - 1, _size(np.maximum(told, 0) // 8)),
        ],
        axis=1,
    )
    fixed = N_WORDS + np.arange(len(FIELDS)) * BINS + bins
    every = np.concatenate((row, np.repeat(np.arange(n), len(FIELDS))))
    order = np.argsort(every, kind="stable")
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(every, minlength=n), out=offsets[1:])
    return offsets, np.concatenate((bucket, fixed.ravel()))[order], np.concatenate((value, np.ones(fixed.size)))[order]


def logit(model: dict, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's output for each row, and Σ v_i x_i. Each row has a feature at least."""
    linear = np.add.reduceat(model["w"][index] * value, offsets[:-1])
    vx = model["v"][index] * value[:, None]
    total = np.add.reduceat(vx, offsets[:-1])
    return model["w0"] + linear + 0.5 * (total**2 - np.add.reduceat(vx**2, offsets[:-1])).sum(axis=1), total


def sigmoid(y: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(y, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> dict:
    """Fit on (indices, values, label) of the sampled documents."""
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(N_FEATURES), "v": rng.normal(0, 0.05, (N_FEATURES, RANK))}
    seen_w, seen_v, seen_0 = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    label = np.array([x[2] for x in rows], float)
    for _ in range(EPOCHS if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            size = [len(rows[k][0]) for k in mine]
            offsets = np.concatenate(([0], np.cumsum(size)))
            index, value = np.concatenate([rows[k][0] for k in mine]), np.concatenate([rows[k][1] for k in mine])
            y, total = logit(model, offsets, index, value)
            slope = (sigmoid(y) - label[mine]) / len(mine)
            per = np.repeat(slope, size) * value
            found, place = np.unique(index, return_inverse=True)
            grad_w = np.bincount(place, per, len(found)) + DECAY * model["w"][found]
            terms = per[:, None] * (np.repeat(total, size, axis=0) - model["v"][index] * value[:, None])
            grad_v = np.zeros((len(found), RANK))
            np.add.at(grad_v, place, terms)
            grad_v += DECAY * model["v"][found]
            seen_0 += slope.sum() ** 2
            seen_w[found] += grad_w**2
            seen_v[found] += grad_v**2
            model["w0"] -= RATE * slope.sum() / np.sqrt(seen_0)
            model["w"][found] -= RATE * grad_w / np.sqrt(seen_w[found])
            model["v"][found] -= RATE * grad_v / np.sqrt(seen_v[found])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the identifier's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """_id and _label of about TRAIN_ROWS documents of each label, none held out, and how many documents have each."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
    one = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most")
    n = {int(x): c for x, c in one.groupBy("_label").count().collect()}
    point = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000))
    keep = F.lit(False)
    for label, count in n.items():
        keep = keep | ((F.col("_label") == label) & (point < int(1_000_000 * min(1.0, TRAIN_ROWS / count)) + 1))
    return one.filter(keep).select("_id", F.col("_label").cast("int").alias("_label")), n


def _with_metadata(docs: DataFrame, id_col: str, text_col: str, size_col: str) -> DataFrame:
    size = F.col(size_col).cast("long") if size_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), size.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", label_col: str = "quality") -> dict | None:
    """The model from a bounded sample of the labelled rows; None without any."""
    chosen, n = sample(labels, id_col, label_col)
    if not n:
        return None
    small = chosen.collect()
    if len(small) > 4 * TRAIN_ROWS:
        raise ValueError(f"the sample has {len(small)} rows, its bound is {4 * TRAIN_ROWS}")
    chosen = F.broadcast(docs.sparkSession.createDataFrame(small, chosen.schema))
    rows = _with_metadata(docs, id_col, text_col, size_col).join(chosen, F.col("doc_id") == F.col("_id")).groupBy("_id", "_label").agg(F.min(F.struct("text", "n_chars")).alias("d"))

    def run(batches):
        for batch in batches:
            offsets, index, value = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(at, pa.array(index, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], ["id", "label", "index", "value"]
            )

    flat = rows.select(F.col("_id").cast("string").alias("id"), F.col("_label").alias("label"), "d.text", "d.n_chars")
    table = map_arrow(flat, run, "id string, label int, index array<int>, value array<float>").toArrow().combine_chunks().sort_by("id")
    read = [(i.values.to_numpy(), v.values.to_numpy().astype(float), y) for i, v, y in zip(table.column("index"), table.column("value"), table.column("label").to_pylist())]
    model = train(read)
    learned = [sum(y == x for *_, y in read) for x in (0, 1)]
    if all(learned):
        model["w0"] += np.log(n.get(1, 0) / n.get(0, 0)) - np.log(learned[1] / learned[0])
    return model


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Per row: doc_id, score (probability of label 1)."""
    rows = _with_metadata(docs, id_col, text_col, size_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
                made = sigmoid(logit(shared.value, *found)[0])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

    return map_arrow(rows, run, f"doc_id {id_type}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", label_col: str = "quality") -> DataFrame:
    """Learn from the labels that aren't held out, then score every row: doc_id, held_out, score, predicted."""
    made = score(docs, fit(docs, labels, id_col, text_col, size_col, label_col), id_col, text_col, size_col)
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
