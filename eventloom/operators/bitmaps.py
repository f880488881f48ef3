"""Packed masks of rules: a bit for each chain, in buckets of 32,768, and what they are good for.

Chains are numbered by company, sequence and identifier, companies by the order of their
first chain, both over the whole table and from 1. A rule's mask is built by
``bitmap_construct_agg`` straight from its boolean column: one row of bits per bucket and
rule, put together on the map side, instead of a row per chain. A formula of rules (all of
these, and one of those) is an AND and an OR of bytes inside a bucket, so any number of
formulas is counted without joining chains; only counts leave the bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.storage import global_rank, written
from eventloom.plans import rules

BITS = 32_768
BYTES = BITS // 8
#: Rules compiled into one projection; more would make the generated code too long.
RULES_AT_ONCE = 40
#: Masks unpacked at once while companies are counted (a byte for each bit).
AT_ONCE = 256


def numbered(contexts: DataFrame) -> DataFrame:
    """The contexts with chain_no and company_no, written once. Identifiers that are null take part like others."""
    key = [F.col(f"chain.{c}") for c in ("company_id", "chain_sequence", "chain_id")]
    # Ranges are sampled from the rows before they move: written first, contexts are made once.
    ranked = global_rank(written(contexts), "chain_no", *key)
    first = ranked.groupBy(F.col("chain.company_id").alias("_company")).agg(F.min("chain_no").alias("_first"))
    companies = global_rank(first, "company_no", F.col("_first")).drop("_first")
    return written(ranked.join(companies, F.col("chain.company_id").eqNullSafe(F.col("_company"))).drop("_company"))


def _packed(rows: DataFrame, number: str, held: dict[str, Column]) -> DataFrame:
    """(atom, bucket, bits): for each name the numbers of the rows that its condition holds for."""
    out, names = None, list(held)
    place = F.bitmap_bit_position(number)
    for at in range(0, len(names), RULES_AT_ONCE):
        part = names[at : at + RULES_AT_ONCE]
        bits = [F.bitmap_construct_agg(F.when(held[k], place)).alias(f"_b{n}") for n, k in enumerate(part)]
        wide = rows.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(*bits)
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("atom"), F.col(f"_b{n}").alias("bits")) for n, k in enumerate(part)]))
        long = wide.select("bucket", pairs.alias("x")).select("x.atom", "bucket", "x.bits").filter(F.bitmap_count("bits") > 0)
        out = long if out is None else out.unionByName(long)
    return out


def of_chains(contexts: DataFrame, atoms: dict[str, dict]) -> DataFrame:
    """(atom, bucket, bits) over chain numbers; contexts as numbered() has them, atoms: rules by name. Empty buckets have no row."""
    return _packed(contexts, "chain_no", {k: rules.compile_rule(r) for k, r in atoms.items()})


def of_columns(contexts: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(atom, bucket, bits) over chain numbers, of conditions on the contexts' own columns."""
    return _packed(contexts, "chain_no", conditions)


def of_companies(contexts: DataFrame, atoms: dict[str, dict]) -> DataFrame:
    """(atom, bucket, bits) over company numbers: the companies with a chain that the rule holds for."""
    names = list(atoms)
    any_of = [F.bool_or(rules.compile_rule(atoms[k])).alias(f"_h{n}") for n, k in enumerate(names)]
    return _packed(contexts.groupBy("company_no").agg(*any_of), "company_no", {k: F.col(f"_h{n}") for n, k in enumerate(names)})


def members(contexts: DataFrame, bitmaps: DataFrame, number: str = "chain_no", keep: tuple[str, ...] = ("chain.chain_id",)) -> DataFrame:
    """(atom, columns kept) for each bit that is set: bitmaps back to rows."""
    at = F.sequence(F.lit(0), F.lit(BITS - 1))
    byte = lambda p: F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    places = F.filter(at, lambda p: F.getbit(byte(p), p % 8) == 1)
    numbers = bitmaps.select("atom", "bucket", F.explode(places).alias("_place"))
    numbers = numbers.select("atom", ((F.col("bucket") - 1) * BITS + F.col("_place") + 1).alias(number))
    return numbers.join(contexts.select(number, *keep), number).drop(number)


def digests(bitmaps: DataFrame, size: int) -> DataFrame:
    """(atom, sha256, n): the digest of a mask as one little-endian number of ``size`` bits, and how many are set.

    Here a mask is in one row, size / 8 bytes (and twice that as text); masks of more than
    2^33 bits would not fit. Atoms without members have no row.
    """
    n_buckets = max(1, -(-size // BITS))
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))
    gathered = bitmaps.groupBy("atom").agg(held.alias("held"), F.sum(F.bitmap_count("bits")).alias("n"))
    empty = F.lit("00" * BYTES)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_buckets)), lambda b: F.coalesce(F.hex(F.try_element_at("held", b.cast("long"))), empty)), "")
    return gathered.select("atom", F.sha2(F.unhex(F.substring(text, 1, 2 * ((size + 7) // 8))), 256).alias("sha256"), "n")


def _first_chains(contexts: DataFrame) -> DataFrame:
    """A row for each bucket: bits where a chain's company is another than the chain's before, and the number of the first company."""
    first = contexts.groupBy("company_no").agg(F.min("chain_no").alias("chain_no"))
    starts = first.groupBy(F.bitmap_bucket_number("chain_no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("chain_no")).alias("bits"))
    least = contexts.groupBy(F.bitmap_bucket_number("chain_no").alias("bucket")).agg(F.min("company_no").alias("company"))
    none = F.lit(bytes(BYTES))
    return least.join(starts, "bucket", "left").select("bucket", F.lit(None).cast("string").alias("atom"), F.coalesce("bits", none).alias("bits"), "company")


def _ones(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=-1, bitorder="little")


def _hashes(numbers: np.ndarray) -> np.ndarray:
    """Four 64-bit words for each number, as SHA-256 has them."""
    return np.array([np.frombuffer(hashlib.sha256(int(n).to_bytes(8, "big")).digest(), ">i8") for n in numbers], np.int64).reshape(-1, 4)


def _in_buckets(contexts: DataFrame, bitmaps: DataFrame, keys: str, batches: Callable, classes: str | None) -> DataFrame:
    """(keys, n_chains, n_companies[, class]) of the masks that ``batches(atoms' bits by name)`` gives in each bucket, where they hold somewhere.

    batches: (list of key tuples, masks) a few at a time. In a bucket, companies lie one after the other,
    so they are counted by runs. Only the first and the last one may go on in another
    bucket; they leave it by number and are counted once.
    """
    rows = bitmaps.select("bucket", "atom", "bits", F.lit(None).cast("long").alias("company")).unionByName(_first_chains(contexts))
    names = [k.split()[0] for k in keys.split(", ")]
    columns = [*names, "n", "inside", "edge", "h0", "h1", "h2", "h3"]

    def in_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[frame.atom.isna()].iloc[0]
        held = {a: np.frombuffer(b, np.uint8) for a, b in zip(frame.atom, frame.bits) if isinstance(a, str)}
        begins = _ones(np.frombuffer(head.bits, np.uint8))
        begins[0] = 1
        runs = np.flatnonzero(begins)
        hashes = _hashes(int(head.company) + np.arange(len(runs))) if classes == "company" else np.zeros((len(runs), 4), np.int64)
        out = []
        for named, masks in batches(held):
            n = np.bitwise_count(masks).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(n)
            for at in range(0, len(some), AT_ONCE):
                part = some[at : at + AT_ONCE]
                for k, row in zip(part, np.maximum.reduceat(_ones(masks[part]), runs, axis=1) > 0):
                    edges = {j for j in (0, len(runs) - 1) if row[j]}
                    row[[0, -1]] = False
                    if classes == "chain":
                        parts = np.frombuffer(hashlib.sha256(int(head.bucket).to_bytes(8, "big") + masks[k].tobytes()).digest(), ">i8")
                    else:
                        parts = np.bitwise_xor.reduce(hashes[row], axis=0) if classes else hashes[0]
                    out.append((*named[k], int(n[k]), int(row.sum()), None, *parts.tolist()))
                    out += [(*named[k], 0, 0, int(head.company) + j, *hashes[j].tolist()) for j in edges]
        return pd.DataFrame(out, columns=columns).astype({"edge": "Int64"})

    found = rows.groupBy("bucket").applyInPandas(in_bucket, f"{keys}, n long, inside long, edge long, h0 long, h1 long, h2 long, h3 long")
    words = [f"h{k}" for k in range(4)]
    # An edge's company counts once, whatever the number of buckets that name it.
    once = found.groupBy(*names, "edge").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), *[F.when(F.col("edge").isNull(), F.bit_xor(h)).otherwise(F.max(h)).alias(h) for h in words])
    aggs = [F.sum("n").alias("n_chains"), (F.sum("inside") + F.count("edge")).alias("n_companies")]
    if classes:
        aggs.append(F.concat_ws("", *[F.lpad(F.hex(F.bit_xor(h)), 16, "0") for h in words]).alias("class"))
    return once.groupBy(*names).agg(*aggs)


Formula = tuple[tuple[str, ...], tuple[str, ...]]


def counts(contexts: DataFrame, bitmaps: DataFrame, formulas: Iterable[Formula], classes: str | None = None) -> DataFrame:
    """(formula, n_chains, n_companies[, class]) of the formulas that hold somewhere, by their place in the list.

    A formula is (all of these atoms, any of those); either part may be empty, not both.
    With classes ("chain" or "company") formulas that hold for the same chains (companies) have one class.
    The list goes to every task: its length is the caller's to bound.
    """
    shared = contexts.sparkSession.sparkContext.broadcast(list(formulas))

    def batches(held):
        none = np.zeros(BYTES, np.uint8)
        for at in range(0, len(shared.value), AT_ONCE):
            masks = []
            for every, some in shared.value[at : at + AT_ONCE]:
                parts = [held.get(a, none) for a in every]
                parts += [reduce(np.bitwise_or, [held.get(a, none) for a in some])] if some else []
                masks.append(reduce(np.bitwise_and, parts))
            yield [(at + k,) for k in range(len(masks))], np.stack(masks)

    return _in_buckets(contexts, bitmaps, "formula int", batches, classes)


def pairs(contexts: DataFrame, bitmaps: DataFrame, structural: list[str], allowed: dict[str, bytes], classes: str | None = None) -> DataFrame:
    """(anchor, structural, n_chains, n_companies[, class]) of the allowed pairs of atoms that share a chain.

    allowed: for each anchor a bit for each structural atom, in the order of the list (low bits first). It goes to
    every task: a bit for each pair.
    """
    shared = contexts.sparkSession.sparkContext.broadcast((structural, allowed))

    def batches(held):
        structural, allowed = shared.value
        there = np.array([k for k, s in enumerate(structural) if s in held], int)
        if not len(there):
            return
        masks = np.stack([held[structural[k]] for k in there])
        for anchor in sorted(allowed):
            if anchor in held:
                mine = np.flatnonzero(_ones(np.frombuffer(allowed[anchor], np.uint8))[there])
                if len(mine):
                    yield [(anchor, structural[there[k]]) for k in mine], masks[mine] & held[anchor]

    return _in_buckets(contexts, bitmaps, "anchor string, structural string", batches, classes)
