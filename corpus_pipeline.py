"""From raw documents to a tokenized training mix.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame. All but the last return
the columns of ``documents``; every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.llm import bpe, exact, jaccard, mixing, quality
from eventloom.llm.common import documents, materialize
from eventloom.llm.registry import vocabulary

#: The least budget at which every source is used once in full: no clean document is lost to the mix.
TARGET = mixing.Target(budget=None)


def quality_rules(spark, docs, sf_dir):
    """Failing lines go, and documents that fail."""
    return quality.clean(docs)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the smallest identifier stays."""
    return exact.keep_one(docs)


def jaccard_join(spark, docs, sf_dir):
    """Of linked documents the smallest identifier stays."""
    return jaccard.one_of_each(docs)


def temperature_mix(spark, docs, sf_dir):
    """Each document as often as its source's weight asks for, once at least."""
    return mixing.mixed_documents(docs, TARGET)


def tokenize(spark, docs, sf_dir):
    """doc_id, source, n_tokens, ids, and the digest of the decoded text."""
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    decoded = bpe.encode_decode(keyed, vocabulary("word_bpe_49k.json"), id_col="key")
    return decoded.select("doc_id.doc_id", "doc_id.source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing", temperature_mix),
    ("BPE", tokenize),
]

#: BPE and the similarity join aren't expressible in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
