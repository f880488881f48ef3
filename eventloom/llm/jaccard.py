"""Exact self-join of documents whose word n-gram sets have a Jaccard similarity of 75 % or more.

1. Each text becomes a set of hashed shingles. Documents with equal sets are one class, so
   copies cost one row each from here on. A class is known by 64 bits; sets that share them
   but not a second hash are told apart by the second one.
2. Blocks. Sets at the threshold share a token of their prefixes under any one order of the
   tokens (prefix filtering). The order puts tokens that many sets hold last, so that
   passages shared by many documents open a block only where hardly anything else is left.
   All tokens of which the same class is the smallest holder open one block together: near
   copies, which share hundreds of tokens, meet in a few blocks. Postings travel as packed
   arrays; frequent tokens have their block from the broadcast list and aren't gathered.
3. In each block, signature trees are traversed in pairs (signature_tree.py). Only members
   that have a candidate go on, with their sets, and the candidates are compared in full
   there: pairs never leave a block, only the links that join components do. Rows are the
   members of blocks throughout.
4. Blocks of more than CHUNK members are cut into chunks, each with the block's smallest
   member. When the links within chunks have been joined to components, a block whose
   members are not one component is joined across chunks, all but the chunks of its largest
   component with each other.

Every pair that shares a block and isn't joined by links already is compared, so no link
between components is lost. Nothing here grows with the data on the driver but counts; the
broadcast list of frequent tokens has at most HOT_MOST entries, because a token on it
stands in 1 / HOT_MOST of all postings or more, and the list of classes that need their
second hash has about rows squared / 2^65.

Defined cases: null or empty text, or a text without words, has an empty set and is linked
with nothing (its component is itself); rows without an identifier have no links and a null
component; rows that share an identifier are judged by their own texts; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm import signature_tree
from eventloom.llm.common import discard, map_arrow, materialize

NGRAM = 5
PERCENT = 75
HOT_MOST = 500_000
HOT_LEAST = 32
#: Tokens counted at once when frequent ones are looked for, and postings packed at once.
COUNTED = 2_000_000
PART_BITS = 3
PARTS = 1 << PART_BITS
PACKED = 1_000_000
#: Bytes of postings in a token range, about.
RANGE_BYTES = 4_000_000
#: Members, and tokens of members, in a chunk of a block.
CHUNK, CHUNK_TOKENS = 1024, 4_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_word_hash = xxhash.xxh3_64_intdigest


def shingle_set(text: str | None, ngram: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a short text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    width = min(ngram, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _K + hashed[k : k + count]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _K
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def class_of(tokens: np.ndarray, second: bool = False) -> int:
    """A signed 64-bit number that stands for the whole set; another one if ``second``."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=int(second))).view(np.int64))


def _class_among(tokens: np.ndarray, shared: frozenset) -> int:
    """The class, by the second hash where different sets share the first."""
    found = class_of(tokens)
    return class_of(tokens, True) if found in shared else found


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens of a set hold one that it shares with any set at the threshold."""
    return n - -(-percent * n // 100) + 1


def early_length(n: int, percent: int) -> int:
    """Of two sets at the threshold, so many first tokens of the smaller one hold one of the prefix of the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _survey(rows: DataFrame, id_type: str, ngram: int) -> DataFrame:
    """A row for each document (doc_id, row_key, n, class, second, bits), and rows (token, df, least) for tokens met often."""
    names = ["doc_id", "row_key", "n", "class", "second", "bits", "token", "df", "least"]
    long, binary = pa.int64(), pa.binary()

    def run(batches):
        id_arrow = None
        held, met, size = [], [], 0
        seen = set()

        def frequent():
            token = np.concatenate(held)
            at = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
            held.clear()
            cls = np.array(met, np.int64)
            for part in range(PARTS):  # by the first bits, so that little is sorted at once
                chosen = np.flatnonzero(token >> np.uint64(64 - PART_BITS) == part)
                order = chosen[np.argsort(token[chosen], kind="stable")]
                mine = token[order]
                starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]][: len(mine)])
                df = np.diff(np.r_[starts, len(mine)])
                often = df >= 3
                if not often.any():
                    continue
                least = np.minimum.reduceat(cls[at[order]], starts)[often]
                empty = [pa.nulls(len(least), t) for t in (id_arrow, long, long, long, long, binary)]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(mine[starts][often].view(np.int64)), pa.array(df[often]), pa.array(least)], names)

        for batch in batches:
            id_arrow = batch.column("doc_id").type
            n, cls, second, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, ngram)
                n.append(len(tokens))
                cls.append(class_of(tokens) if len(tokens) else None)
                second.append(class_of(tokens, True) if len(tokens) else None)
                bits.append(signature_tree.bitmap(tokens).tobytes() if len(tokens) else None)
                if len(tokens) and cls[-1] not in seen:
                    seen.add(cls[-1])
                    met.append(cls[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= COUNTED:
                        yield from frequent()
                        held, met, size = [], [], 0
                        seen = set()
            made = [pa.array(x, t) for x, t in zip((n, cls, second, bits), (long, long, long, binary))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *made, *[pa.nulls(len(n), long)] * 3], names)
        if held:
            yield from frequent()

    return map_arrow(rows, run, f"doc_id {id_type}, row_key long, n long, class long, second long, bits binary, token long, df long, least long")


def _postings(rows: DataFrame, hot, ranges: int, shared: frozenset, ngram: int, percent: int) -> DataFrame:
    """Packed postings of the prefixes: (range, keys, classes, sizes).

    Keys are tokens (uint32 inside their range). In ranges below 0 they are blocks (int64),
    those of frequent tokens; such a range has all postings of its classes. Sizes are twice
    the number of tokens, and 1 more for an early token.
    """
    names = ["range", "keys", "classes", "sizes"]

    def run(batches):
        frequent, its_block = hot.value
        held, met, size = [], set(), 0

        def packed():
            for rare in (True, False):
                keys = np.concatenate([h[0 if rare else 1] for h in held])
                if not len(keys):
                    continue
                times = [len(h[0 if rare else 1]) for h in held]
                cls = np.repeat(np.array([h[2] for h in held], np.int64), times)
                n = np.repeat(np.array([2 * h[3] for h in held], np.int32), times)
                if rare:
                    n += np.arange(len(n)) - np.repeat(np.cumsum(times) - times, times) < np.repeat([h[4] for h in held], times)
                spread = keys if rare else cls.view(np.uint64) * _K
                place = (((spread >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                keys, cls, n, place = keys[order].astype(np.uint32 if rare else np.int64), cls[order], n[order], place[order]
                cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
                out = [(int(place[a]) if rare else -1 - int(place[a]), keys[a:b].tobytes(), cls[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                for at in range(0, len(out), 64):
                    part = list(zip(*out[at : at + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *[pa.array(x, pa.binary()) for x in part[1:]]], names)

        for batch in batches:
            ids = batch.column("doc_id")
            for k, text in enumerate(batch.column("text").to_pylist()):
                tokens = shingle_set(text, ngram)
                if not len(tokens) or not ids[k].is_valid:
                    continue
                cls = _class_among(tokens, shared)
                if cls in met:
                    continue
                met.add(cls)
                count, blocks = prefix_length(len(tokens), percent), np.empty(0, np.int64)
                rare = tokens
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    late = frequent[at] == tokens
                    rare = tokens[~late]
                    if count > len(rare):
                        blocks = np.unique(its_block[at[late][: count - len(rare)]])
                rare = rare[:count]
                held.append((rare, blocks, cls, len(tokens), early_length(len(tokens), percent)))
                size += len(rare) + len(blocks)
                if size >= PACKED:
                    yield from packed()
                    held, met, size = [], set(), 0
        if size:
            yield from packed()

    return map_arrow(rows, run, "range int, keys binary, classes binary, sizes binary")


def _blocks(postings: DataFrame, percent: int) -> DataFrame:
    """(block, class, n): a class joins the block of the smallest class that shares a prefix token with it.

    A token's list keeps those that one of the others there could be linked with: by their
    sizes, and because the token is an early one of the smaller set.
    """

    def run(table: pa.Table) -> pa.Table:
        rare = table.column("range")[0].as_py() >= 0
        key, cls, n = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("keys", np.uint32 if rare else np.int64), ("classes", np.int64), ("sizes", np.int32)))
        early, n = n % 2 == 1, n.astype(np.int64) // 2
        order = np.lexsort((~early, cls, n, key) if rare else (cls, key))
        key, cls, n, early = key[order], cls[order], n[order], early[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls, n, early = key[new], cls[new], n[new], early[new]
        if rare:
            order = np.lexsort((~early, n, key))
            key, cls, n, early = key[order], cls[order], n[order], early[order]
            same = key[1:] == key[:-1]
            # An early one and the next larger one; any one and the last early one before it.
            follows = np.r_[same & early[:-1] & (100 * n[:-1] >= percent * n[1:]), False]
            last = np.maximum.accumulate(np.where(early, np.arange(len(key)), 0))
            before = np.r_[0, last[:-1]]
            led = early[before] & (key[before] == key) & (before < np.arange(len(key))) & (100 * n[before] >= percent * n)
            key, cls, n = key[follows | led], cls[follows | led], n[follows | led]
            order = np.lexsort((cls, key))
            key, cls, n = key[order], cls[order], n[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            block = np.repeat(cls[starts], np.diff(np.r_[starts, len(key)]))
            order = np.lexsort((cls, block))
            block, cls, n = block[order], cls[order], n[order]
            new = np.r_[True, (block[1:] != block[:-1]) | (cls[1:] != cls[:-1])][: len(block)]
            key, cls, n = block[new], cls[new], n[new]
        return pa.table({"block": key, "class": cls, "n": n})

    return postings.groupBy("range").applyInArrow(run, "block long, class long, n long").distinct()


GROUP = ("block", "part_a", "part_b")


def _whole_groups(batches):
    """Tables of whole groups from batches that are sorted by GROUP, with the row where each group starts."""
    waiting = []
    for batch in batches:
        values = [batch.column(c).to_numpy() for c in GROUP]
        first = np.logical_or.reduce([np.r_[True, v[1:] != v[:-1]] for v in values])
        at = int(np.flatnonzero(first)[-1]) if batch.num_rows else 0
        goes_on = bool(waiting) and all(waiting[-1].column(c)[-1].as_py() == v[0] for c, v in zip(GROUP, values))
        if at or (waiting and not goes_on):
            parts = [*waiting, batch.slice(0, at)]
            yield pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks()
            waiting = []
        waiting.append(batch.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _numbered(table: pa.Table) -> np.ndarray:
    """The number of each row's group."""
    values = [table.column(c).to_numpy() for c in GROUP]
    return np.cumsum(np.logical_or.reduce([np.r_[False, v[1:] != v[:-1]] for v in values]))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    part, a, b = (table.column(c).to_numpy() for c in ("part", "part_a", "part_b"))
    return part == b, a != b


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition(*GROUP).sortWithinPartitions(*GROUP)


MEMBER = "block long, part_a long, part_b long, part long, class long, component long, n long"


def _held(members: DataFrame, percent: int) -> DataFrame:
    """The members that have a candidate in their group. members: MEMBER and bits."""
    names = [c.split()[0] for c in MEMBER.split(", ")]

    def run(batches):
        for table in _whole_groups(batches):
            if len(table) < 2:
                continue
            sets = signature_tree.Sets(_numbered(table), *(table.column(c).to_numpy() for c in ("n", "component")), table.column("bits").to_pylist())
            some = np.zeros(len(table), bool)
            for i, j, _ in signature_tree.candidates(sets, *_sides(table), percent):
                some[i] = some[j] = True
            yield from table.select(names).filter(pa.array(some)).combine_chunks().to_batches()

    return map_arrow(_dealt(members), run, MEMBER)


def _links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of each group. members: MEMBER and tokens (uint64 as bytes)."""

    def joined(table: pa.Table) -> tuple[list[int], list[int]]:
        group, n, cls = _numbered(table), table.column("n").to_numpy(), table.column("class").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        _, component = np.unique(np.stack([group, table.column("component").to_numpy()]), axis=1, return_inverse=True)
        component = component.ravel()
        sets = signature_tree.Sets(group, n, component, [signature_tree.bitmap(t).tobytes() for t in tokens])
        # Tokens as small numbers, so that a set is a mark on a flat array.
        every, number = np.unique(np.concatenate(tokens), return_inverse=True)
        cuts = np.r_[0, np.cumsum(n)]
        marked = np.zeros(len(every), bool)
        parent = np.arange(component.max() + 1)

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        for i, j, bound in signature_tree.candidates(sets, *_sides(table), percent):
            order = np.lexsort((-bound, i))
            i, j = i[order], j[order]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            for x, partners in zip(i[starts].tolist(), np.split(j, starts[1:])):
                mine = number[cuts[x] : cuts[x + 1]]
                marked[mine] = True
                at, step = 0, 8
                while at < len(partners):
                    # The best bounds first: those that a link joins needn't be compared after it.
                    here = find(component[x])
                    some = [y for y in partners[at : at + step].tolist() if find(component[y]) != here]
                    at, step = at + step, step * 4
                    if not some:
                        continue
                    flat = np.concatenate([number[cuts[y] : cuts[y + 1]] for y in some])
                    common = np.add.reduceat(marked[flat], np.r_[0, np.cumsum(n[some])[:-1]], dtype=np.int64)
                    for y in np.array(some)[100 * common >= percent * (n[x] + n[some] - common)].tolist():
                        p, q = find(component[x]), find(component[y])
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                            out_a.append(int(cls[x]))
                            out_b.append(int(cls[y]))
                marked[mine] = False
        return out_a, out_b

    def run(batches):
        for table in _whole_groups(batches):
            if len(table) >= 2:
                a, b = joined(table)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_arrow(_dealt(members), run, "a long, b long")


def components(edges: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(vertex, component): the smallest vertex that edges (a, b) reach, on top of the components of ``label``.

    In each round every vertex points to its smallest neighbour, then to where that one
    points; edges take the labels of their ends, and those within a component go. Edges and
    vertices shrink by half or more; each step is written to the shared folder.
    """
    if label is not None:
        edges = _relabelled(edges, label)
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("vertex", "next")
        point = materialize(both.groupBy("vertex").agg(F.least("vertex", F.min("next")).alias("component")), "points")
        jump = point.select(F.col("vertex").alias("component"), F.col("component").alias("far"))
        step = materialize(point.join(jump, "component").select("vertex", F.col("far").alias("component")), "labels")
        if label is None:
            label = step
        else:
            moved = step.select(F.col("vertex").alias("component"), F.col("component").alias("to"))
            old = label.join(moved, "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
            label = materialize(old.union(step.join(label.select("vertex"), "vertex", "left_anti")), "labels")
        edges = materialize(_relabelled(edges, step).filter("a <> b").distinct(), "edges")
    return label if label is not None else edges.toDF("vertex", "component")


def _relabelled(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Edges between the components of their ends; a vertex without a label is its own component."""
    for end in ("a", "b"):
        named = label.select(F.col("vertex").alias(end), F.col("component").alias("to"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.select("a", "b")


def _grouped(docs: DataFrame, id_col: str, text_col: str, row_key: Column, ngram: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, row_key, n, class, component (a number), component_id (the smallest doc_id of the component); and the tables that this reads."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key.cast("long").alias("row_key"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    surveyed = materialize(_survey(rows, id_type, ngram), "survey")
    known = surveyed.filter(F.col("token").isNull())
    some = known.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    # Different sets with one 64-bit number: about rows squared / 2^65 of them.
    twice = some.groupBy("class").agg((F.min("second") != F.max("second")).alias("differ")).filter("differ")
    shared = frozenset(r[0] for r in twice.select("class").collect())
    if shared:
        known = known.withColumn("class", F.when(F.col("class").isin(*shared), F.col("second")).otherwise(F.col("class")))
        some = some.withColumn("class", F.when(F.col("class").isin(*shared), F.col("second")).otherwise(F.col("class")))
    classes = materialize(some.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    least = max(HOT_LEAST, total // HOT_MOST)
    often = surveyed.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("df").alias("df"), F.min("least").alias("least")).filter(F.col("df") >= least)
    often = often.select("token", "least").toArrow()
    tokens, pivots = often.column("token").to_numpy().view(np.uint64), often.column("least").to_numpy()
    order = np.argsort(tokens)
    hot = spark.sparkContext.broadcast((tokens[order], pivots[order]))
    ranges = max(16, total * 4 // RANGE_BYTES)
    blocks = materialize(_blocks(_postings(rows, hot, ranges, shared, ngram, percent), percent), "blocks")

    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_TOKENS))
    large = materialize(blocks.groupBy("block").agg(parts.alias("parts")).filter("parts > 1"), "large")
    some_large = not large.isEmpty()
    part_of = lambda parts: F.pmod(F.xxhash64("class"), parts)
    if some_large:
        cut = blocks.join(large, "block", "left")
        own = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long")))
        own = own.when(F.col("class") == F.col("block"), F.array().cast("array<long>")).otherwise(F.array(part_of(F.col("parts"))))
        members = cut.select("block", "class", F.explode(own).alias("part"))
        # The block's smallest class is in all of its chunks.
        members = members.union(large.select("block", F.col("block").alias("class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    else:
        members = blocks.select("block", "class", F.lit(0).cast("long").alias("part"))
    members = members.select("block", F.col("part").alias("part_a"), F.col("part").alias("part_b"), "part", "class", F.col("class").alias("component"))
    label = _joined(rows, classes, members, None, shared, ngram, percent)

    if some_large:
        label = _across(rows, classes, blocks, large, label, shared, ngram, percent)
    discard(blocks, large)

    labelled = classes.select("class", "doc_id").join(label.withColumnRenamed("vertex", "class"), "class")
    # Written, so that nothing but the join stands above its exchanges and Spark may split a component that is everywhere.
    least_of = materialize(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    alone = classes.join(label.select(F.col("vertex").alias("class")), "class", "left_anti")
    of_class = labelled.join(least_of, "component").select("class", "component", "component_id").union(alone.select("class", F.col("class").alias("component"), F.col("doc_id").alias("component_id")))
    return known.select("doc_id", "row_key", "n", "class").join(of_class, "class", "left"), [surveyed, classes, least_of]


def _joined(rows, classes, members, label, shared, ngram, percent) -> DataFrame:
    """The labels after all pairs within the groups of members (MEMBER without n) were compared."""
    # Bitmaps are wide, so they are joined last and shuffled once; sets go to members with candidates only.
    held = materialize(_held(members.join(classes.drop("doc_id"), "class"), percent), "held")
    # Written, so that a short list is known to be short and no text moves for it.
    wanted = materialize(classes.select("class", F.col("doc_id").alias("of")).join(held.select("class").distinct(), "class", "left_semi"), "wanted")
    links = materialize(_links(held.join(_sets(rows, wanted, shared, ngram), "class"), percent), "links")
    out = components(links, label)
    discard(held, wanted, links)
    return out


def _across(rows, classes, blocks, large, label, shared, ngram, percent) -> DataFrame:
    """The labels after the members of large blocks were compared across chunks too.

    The largest component of a block is cut into chunks of its own, which aren't compared
    with each other.
    """
    named = blocks.join(large.select("block"), "block", "left_semi").join(label.withColumnRenamed("vertex", "class"), "class", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "class")), "named")
    sizes = named.groupBy("block", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    of_top = F.max_by(F.struct("component", "m", "n"), F.struct("m", "component"))
    per = sizes.groupBy("block").agg(of_top.alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    parts = lambda m, n: F.greatest(F.ceil(m / CHUNK), F.ceil(n / CHUNK_TOKENS))
    layout = per.select(
        "block", F.col("top.component").alias("top"), parts(F.col("top.m"), F.col("top.n")).alias("of_top"),
        parts(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("of_rest"),
    )
    layout = materialize(layout, "layout")
    if layout.isEmpty():
        return label
    placed = named.join(layout.hint("merge"), "block")
    is_top = F.col("component") == F.col("top")
    part = F.when(is_top, F.col("of_rest") + F.pmod(F.xxhash64("class"), "of_top")).otherwise(F.pmod(F.xxhash64("class"), "of_rest"))
    last = F.when(is_top, F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_top")) - 1
    placed = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    members = placed.select("block", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "class", "component")
    out = _joined(rows, classes, members, label, shared, ngram, percent)
    discard(named, layout)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    found, _ = _grouped(docs, id_col, text_col, F.lit(None), ngram, percent)
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"))


def _sets(rows: DataFrame, wanted: DataFrame, shared: frozenset, ngram: int) -> DataFrame:
    """(class, tokens) of the wanted classes, from the text of one document of each. wanted: class, of."""
    joined = rows.join(wanted, rows["doc_id"] == wanted["of"]).select("text", "class")

    def run(batches):
        for batch in batches:
            found = []
            for text, cls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = shingle_set(text, ngram)
                if len(tokens) and _class_among(tokens, shared) == cls:  # another row may have the same identifier
                    found.append((cls, tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["class", "tokens"])

    # Repeated rows give a class twice.
    return map_arrow(joined, run, "class long, tokens binary").dropDuplicates(["class"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another one of their group stands for: of each group
    the row with the smallest identifier stays (of rows that share it, one).

    Rows without an identifier or without words stay.
    """
    names = set(docs.columns)
    own = next(f"_row_key{k or ''}" for k in range(len(names) + 1) if f"_row_key{k or ''}" not in names)
    keyed = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    grouped, tables = _grouped(keyed, id_col, text_col, F.col(own), NGRAM, PERCENT)
    grouped = grouped.filter(F.col("doc_id").isNotNull() & F.col("component").isNotNull())
    found = materialize(grouped.select("doc_id", "row_key", "component", "component_id"), "groups")
    discard(*tables)
    # Only rows with the smallest identifier of their group can stay, and these are few.
    first = found.filter("doc_id = component_id").groupBy("component", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("component").orderBy("row_key")
    judged = materialize(first.withColumn("nth", F.row_number().over(best)), "judged")
    again = judged.filter("nth = 1 AND times > 1")
    others = found.filter("doc_id <> component_id").select("doc_id", "row_key").unionByName(judged.filter("nth > 1 OR times > 1").select("doc_id", "row_key"))
    # Written, so that a short list is known to be short and no text moves for it.
    named = lambda df, name: materialize(df.select(F.col("doc_id").alias(id_col), F.col("row_key").alias(own)).distinct(), name)
    single = keyed.join(named(others, "others"), [id_col, own], "left_anti")
    if not again.isEmpty():
        single = single.unionByName(keyed.join(named(again, "again"), [id_col, own], "left_semi").dropDuplicates([id_col, own]))
    discard(found, judged)
    return single.select(docs.columns)
