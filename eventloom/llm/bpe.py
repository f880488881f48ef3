"""BPE encoding and decoding with a tokenizers JSON file, merged in batches by numpy.

A text is cut at special tokens, then at white space: neither the normaliser (NFC, white
space, lower case) nor the splitting pattern reaches across white space, so each chunk
encodes on its own and its ids are cached. The words of all chunks that a batch meets for
the first time lie as symbols in one flat array; in every round numpy looks up all adjacent
pairs by binary search over the sorted pair keys, finds the lowest rank of each word, and
merges it in all words at once. With it go all pairs that would be merged whatever happens
before their turn: those of a rank below that of any pair which a merge of the word could
make, if both neighbours' ranks are higher. So long words take few rounds, too. Words
without a merge left leave the array.

Supported files: model BPE with an end-of-word suffix and neither unknown token, dropout
nor byte fallback; normalisers NFC, Replace of white space, Lowercase; pre-tokenizers
Split (pattern kept) and ByteLevel without prefix space; no decoder, so that decoding joins
the tokens by spaces.

Defined cases: null is an empty text (no ids; decoded to an empty text); texts of any
length are encoded whole, in pieces cut at white space; rows are encoded one by one, so
repeated rows and null identifiers stay; an empty table gives an empty result; columns
other than the two named play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from eventloom.llm.common import map_arrow

#: Characters whose chunks are held at once, and chunks cached by a worker (in each of two generations).
PIECE = 1 << 20
CACHED = 200_000
NONE = np.iinfo(np.int32).max

#: White space as Unicode has it; str.split() also splits at 1C to 1F, which are no white space there.
_SPACE = "\t-\r \x85\xa0  -     　"
_not_space = re.compile(f"[^{_SPACE}]+")
_odd = re.compile("[\x1c-\x1f]")
_break = re.compile(f"[{_SPACE}]")

#: Letters and numbers that Unicode 17 added. The pattern engine that the files
#: are written for doesn't know them yet, so they count as neither.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_newer = re.compile(f"[{NEWER}]")
#: Lower-case forms of capitals that Unicode 16 and 17 added; a sigma has no final form.
LOWER = {
    **{0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B},
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """The vocabulary and merges of a file, and the cache of chunks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("a tokenizer of this kind isn't supported")
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.words_of = regex.compile(pattern).findall
        # Where a newer character occurs, \p{L} and \p{N} stand for what they are without it.
        older = pattern.replace(r"[\p{L}]", f"[\\p{{L}}--[{NEWER}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{NEWER}]]")
        older = older.replace(rf"[^{_SPACE}\p{{L}}\p{{N}}]", rf"[[^{_SPACE}\p{{L}}\p{{N}}]||[{NEWER}]]")
        self.older_words_of = regex.compile(older, regex.V1).findall
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        self._read_merges(model["merges"], vocab)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        self.tokens = [names.get(i, "") for i in range(self.size)]
        self.pieces = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _read_merges(self, merges: list, vocab: dict) -> None:
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        # A merge is safe to make at all its places at once if no merge of what it makes has a lower rank.
        first_use = np.full(len(vocab) + 1, NONE, np.int32)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.base = np.int64(len(vocab) + 1)
        order = np.argsort(left * self.base + right, kind="stable")
        self.keys = (left * self.base + right)[order]
        self.rank, self.made, self.safe = rank[order], made[order], (first_use[made] > rank)[order]
        self.next_use = first_use[made][order]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (int32, as bytes) of each word, given as UTF-8."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        while len(symbol):
            same = word[1:] == word[:-1]
            key = np.where(same, symbol[:-1] * self.base + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.rank[at], NONE), NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            length = np.diff(np.r_[starts, len(symbol)])
            low = np.minimum.reduceat(rank, starts)
            # The lowest rank that a merge of the word could bring in; ranks below it keep their order.
            bringing = np.append(np.where(rank[:-1] != NONE, self.next_use[at], NONE), NONE)
            limit = np.repeat(np.maximum(np.minimum.reduceat(bringing, starts), low + (low != NONE)), length)
            over = np.repeat(low == NONE, length)
            if over.any():
                done_symbol.append(symbol[over])
                done_word.append(word[over])
            # Runs of one rank are merged from their start, in every other place.
            before, after = np.r_[NONE, rank[:-1]], np.r_[rank[1:], NONE]
            fits = (rank < limit) & ~over
            starts_run = fits & (before != rank)
            number = np.maximum.accumulate(np.where(starts_run, np.arange(len(rank)), 0))
            hit = fits & (before[number] > rank) & (after >= rank) & ((np.arange(len(rank)) - number) % 2 == 0)
            places = np.flatnonzero(hit)
            if len(places):
                # Where a merge could bring in a lower rank, only the first place of the word counts.
                new_word = np.r_[True, word[places[1:]] != word[places[:-1]]]
                places = places[new_word | self.safe[at[places]]]
                symbol[places] = self.made[at[places]]
                stay = ~over
                stay[places + 1] = False
            else:
                stay = ~over
            symbol, word = symbol[stay], word[stay]
        if not done_symbol:
            return [b""] * len(words)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = np.concatenate(done_symbol)[order].tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk, normalised."""
        if chunk.isascii():
            chunk = chunk.lower()
            return [chunk] if chunk.isalpha() else self.words_of(chunk)
        chunk = unicodedata.normalize("NFC", chunk).translate(LOWER).lower()
        return (self.older_words_of if _newer.search(chunk) else self.words_of)(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Make sure that ``young`` holds the chunks."""
        if len(self.young) + len(chunks) > CACHED:
            self.old, self.young = self.young, {}
        young, old, order, split = self.young, self.old, [], []
        for chunk in chunks:
            if chunk in young:
                continue
            known = old.get(chunk)
            if known is None:
                order.append(chunk)
                split.append(self.split(chunk))
            else:
                young[chunk] = known
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.merge([w.encode("utf-8", "surrogatepass") for w in words]))) if words else {}
        for chunk, ws in zip(order, split):
            young[chunk] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens; they should be about PIECE characters together."""
        split = [_not_space.findall(t) if _odd.search(t) else t.split() for t in texts]
        chunks = set().union(*split)
        if not chunks <= self.young.keys():
            self.learn(chunks)
        get = self.young.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def _encode_long(self, text: str) -> bytes:
        """A text of any length, with special tokens or not."""
        found, at = [], 0
        cuts = [(m.start(), m.end(), self.special[m[0]]) for m in self.at_special.finditer(text)] if self.at_special else []
        for start, end, special in [*cuts, (len(text), len(text), None)]:
            while at < start:
                cut = _break.search(text, at + PIECE, start) if start - at > PIECE else None
                to = cut.start() if cut else start
                found += self._encode_plain([text[at:to]])
                at = to
            if special is not None:
                found.append(np.int32(special).tobytes())
            at = end
        return b"".join(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        found: list[bytes] = [b""] * len(texts)
        waiting, size = [], 0

        def settle():
            for i, ids in zip(waiting, self._encode_plain([texts[i] for i in waiting])):
                found[i] = ids

        for i, text in enumerate(texts):
            if len(text) > PIECE or self.at_special and "<" in text and self.at_special.search(text):
                found[i] = self._encode_long(text)
                continue
            waiting.append(i)
            size += len(text)
            if size > PIECE:
                settle()
                waiting, size = [], 0
        settle()
        return found


    def forget(self) -> None:
        """Empty the caches."""
        self.young, self.old = {}, {}

    def encode_array(self, texts: list) -> pa.ListArray:
        """The ids of the texts of a batch; null is an empty text."""
        found = self.encode([t or "" for t in texts])
        offsets = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), np.int32))

    def decode_array(self, ids: pa.ListArray) -> pa.StringArray:
        """The decoded texts of a batch: the tokens joined by spaces; null ids are an empty text."""
        if self.pieces is None:
            # Each token is there twice: with a space before it, and as the first of a text.
            self.pieces = pa.array([" " + t for t in self.tokens] + self.tokens, pa.string())
        values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.array(ids.value_lengths().fill_null(0))
        bounds = np.r_[0, np.cumsum(lengths)]
        values[bounds[:-1][lengths > 0]] += len(self.tokens)
        flat = self.pieces.take(pa.array(values))
        ends = np.frombuffer(flat.buffers()[1], np.int32)[: len(values) + 1] if len(values) else np.zeros(1, np.int32)
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends[bounds].tobytes()), flat.buffers()[2])


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The file's encoder, loaded once by a worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids, an array of int. path: a file that every executor can open."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bpe.encode_array(batch.column("text").to_pylist())], ["doc_id", "ids"])
        bpe.forget()  # the worker lives on

    return map_arrow(rows, run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and the decoded text; null ids decode to an empty text."""
    schema = StructType([*encoded.schema.fields, StructField(into, StringType())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_array(batch.column(ids_col))], [*batch.schema.names, into])

    return map_arrow(encoded, run, schema)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in a single pass: doc_id, ids, decoded."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = bpe.encode_array(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, bpe.decode_array(ids)], ["doc_id", "ids", "decoded"])
        bpe.forget()

    return map_arrow(rows, run, f"doc_id {id_type}, ids array<int>, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns from what decode() returns."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
