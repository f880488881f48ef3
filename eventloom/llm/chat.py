"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds a conversation again after every turn. Each conversation gets a
rolling hash of its turns, one for every prefix. A conversation whose whole hash is a
shorter prefix of another one is dropped by an anti-join; of equal conversations the one
with the smallest identifier stays. What is left, the maximal conversations, is rendered.

Turns are ordered by (turn, role, text), nulls first; rows repeated in full count once.
Roles and texts that are null are rendered, and compared, as empty.

Defined cases: rows without a conversation identifier belong to no conversation and are
left out; an empty table gives an empty result; other columns play no part. A conversation
is rendered into one row, so it is gathered in one task.

Only hashes are kept of all conversations; the turns of the maximal ones are read again
from the log and rendered then, so that snapshots cost no rendering.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, map_arrow, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{role}\n{text}{CLOSE}\n" for role, text in turns)


def prefix_hashes(turns: list[tuple[str, str]]) -> list[bytes]:
    """The rolling hash after each turn."""
    found, state = [], b""
    for role, text in turns:
        role, text = role.encode(), text.encode()
        state = hashlib.blake2b(b"%b%d %d " % (state, len(role), len(text)) + role + text, digest_size=16).digest()
        found.append(state)
    return found


def _turns(logged: DataFrame, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turns: the turns in order. logged has a column conv_id."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return logged.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))


def _hashes(grouped: DataFrame) -> DataFrame:
    """conv_id, n_turns, whole (the hash of all turns), shorter (those of the prefixes)."""
    id_type = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [prefix_hashes([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column("turns").to_pylist()]
            columns = [pa.array([len(h) for h in found], pa.int64()), pa.array([h[-1] for h in found], pa.binary()), pa.array([h[:-1] for h in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "whole", "shorter"])

    return map_arrow(grouped, run, f"conv_id {id_type}, n_turns long, whole binary, shorter array<binary>")


def _rendered(grouped: DataFrame) -> DataFrame:
    """conv_id, rendered."""
    id_type = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(text, pa.string())], ["conv_id", "rendered"])

    return map_arrow(grouped, run, f"conv_id {id_type}, rendered string")


def collapse(logged: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_equal (conversations that are the same), rendered."""
    log = logged.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conversations = materialize(_hashes(_turns(log, "turn", "role", "text")), "conversations")
    extended = conversations.select(F.explode("shorter").alias("whole")).distinct()
    equal = conversations.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"), F.first("n_turns").alias("n_turns"))
    maximal = materialize(equal.join(extended, "whole", "left_anti").select("conv_id", "n_turns", "n_equal"), "maximal")
    discard(conversations)
    rendered = _rendered(_turns(log.join(maximal.select("conv_id"), "conv_id", "left_semi"), "turn", "role", "text"))
    return rendered.join(maximal, "conv_id").select("conv_id", "n_turns", "n_equal", "rendered")


#: The same result in DuckDB: every prefix is compared in full.
ORACLE = rf"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
shorter AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
equal AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_equal,
       list_reduce(list_concat([''], list_transform(turns, lambda t: '{OPEN}' || t.role || chr(10) || t.text || '{CLOSE}' || chr(10))), lambda a, b: a || b) AS rendered
FROM equal ANTI JOIN shorter USING (turns)
"""
