"""Exact deduplication by content sort, with DataFrame operations only.

Normalised texts are range-partitioned (Spark samples the splitters), each partition is
sorted externally, and every row is compared with its neighbour in full. The range key is
the text's first KEY characters with a fingerprint, not the whole text: what Spark samples
for the splitters goes to the driver and has to stay small. Inside a range the sort, and
the comparison of neighbours, are by the whole text.

A text whose copies are too much for one task, by rows or by characters, is dealt over as
many sub-ranges as it needs; the heads of the runs in them are then merged, again by their
full texts. There are PORTIONS such texts by rows and as many by characters at most, with
no more sub-ranges than twice that, whatever the size of the table: so the lists that are
broadcast are bounded.

Defined cases: null text counts as empty; null identifiers sort last and win only if the
whole group has none; of rows repeated with the smallest identifier one stays; an empty
table gives an empty result; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, normalised

#: A task sorts so many rows and characters of one text without trouble, or this part of all.
HOT_LEAST, HOT_CHARS, PORTIONS = 1000, 64 << 20, 50_000
#: Characters of a text that splitters are made of.
KEY = 64


def _hot(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(fp, salts) of the texts that are dealt over several sub-ranges. rows: fp, norm."""
    per = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("norm")).alias("chars"))
    per = per.filter((F.col("n") > HOT_LEAST) | (F.col("chars") > HOT_CHARS))
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(text_col))), F.lit(0))).first()
    salts = F.greatest(F.ceil(F.col("n") / max(HOT_LEAST, n // PORTIONS)), F.ceil(F.col("chars") / max(HOT_CHARS, chars // PORTIONS)))
    return per.select("fp", salts.cast("int").alias("salts")).filter("salts > 1")


def _runs(docs: DataFrame, id_col: str, text_col: str, carried: list) -> tuple[DataFrame, list[str]]:
    """Rows in content order, with the head of each run of equal texts marked, and what names a run.

    doc_id, carried columns, fp, salt, run, head, run_keep, run_size, and of the heads in sub-ranges the text.
    Texts travel once: as they are where columns are carried, else normalised.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    keyed = rows.withColumn("norm", norm).withColumn("fp", F.xxhash64("norm"))
    if not carried:
        keyed, norm = keyed.withColumn("text", F.col("norm")), F.col("text")
    hot = _hot(keyed.select("fp", "norm"), docs, text_col)
    # Null identifiers have to be dealt, too, so rows are dealt by their place in the input.
    keyed = keyed.join(F.broadcast(hot), "fp", "left").withColumn("prefix", F.substring("norm", 1, KEY))
    keyed = keyed.withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"), F.lit(-1))).drop("norm", "salts")
    place = ["prefix", "fp", "salt"]
    ranged = keyed.repartitionByRange(*place).withColumn("norm", norm)
    in_order = Window.partitionBy(*place).orderBy("norm", F.col("doc_id").asc_nulls_last())
    marked = ranged.withColumn("head", ~F.col("norm").eqNullSafe(F.lag("norm").over(in_order)))
    marked = marked.withColumn("run", F.sum(F.col("head").cast("long")).over(in_order))
    of_run = Window.partitionBy(*place, "run")
    marked = marked.withColumns({"run_keep": F.min("doc_id").over(of_run), "run_size": F.count(F.lit(1)).over(of_run)})
    marked = marked.withColumns({"text_sha256": F.sha2("norm", 256), "hot_text": F.when(F.col("head") & (F.col("salt") >= 0), F.col("norm"))})
    return marked.drop("prefix", "norm"), ["fp", "salt", "run"]


def _merged(runs: DataFrame, run: list[str]) -> DataFrame:
    """For each run of a sub-range: the smallest identifier and size of the whole group, and whether its head stays. Bounded as the sub-ranges are."""
    heads = runs.filter(F.col("hot_text").isNotNull())
    best = F.min(F.struct(F.col("run_keep").isNull().alias("none"), "run_keep", *run))
    whole = heads.groupBy("hot_text").agg(best.alias("best"), F.sum("run_size").alias("hot_size"))
    joined = heads.select(*run, "hot_text").join(whole, "hot_text")
    stays = F.struct(*run) == F.struct(*[F.col(f"best.{c}") for c in run])
    return joined.select(*run, F.col("best.run_keep").alias("hot_keep"), "hot_size", stays.alias("hot_stays"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs, run = _runs(docs, id_col, text_col, [])
    runs = materialize(runs.drop("text"), "content-sort")
    joined = runs.drop("hot_text").join(F.broadcast(_merged(runs, run)), run, "left")
    in_hot = F.col("hot_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(in_hot, F.col("hot_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        (F.col("head") & F.coalesce("hot_stays", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their own columns, one of each group of equal texts; of a group without identifiers, one too."""
    # The other columns travel as one, so that no name of theirs meets one of ours.
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    runs, run = _runs(docs, id_col, text_col, [whole.alias("whole")])
    heads = materialize(runs.filter("head").select("doc_id", "text", "whole", *run, "run_keep", "run_size", "hot_text"), "heads")
    joined = heads.drop("hot_text").join(F.broadcast(_merged(heads, run)), run, "left").filter(F.coalesce("hot_stays", F.lit(True)))
    named = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return joined.select(*[(named[c] if c in named else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


#: The same result in DuckDB.
ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
