"""Centroid clustering of vectors in exact integer arithmetic (Lloyd's rounds).

Vectors are packed once into blocks of integers, written to the shared folder, and read in
every round. A block's squared distances come from |x|² - 2x·c + |c|² with one float64
matrix product. Every number on that way is an integer of at most dims * (max|x| + max|c|)²,
so a row under LIMIT = 2^53 by that bound is exact, whatever the order of the sums; rows
beyond it are done again in 64-bit integers, and beyond 2^63 in Python's. Each block is
reduced to a count and a sum of components for each cluster; RDD.treeAggregate adds them
up over levels, so the driver gets k * dims integers however many vectors there are.

Defined cases: vectors of another length, null ones, and ones with a null, NaN or infinite
component are left out; a row without identifier is assigned, but is no starting
centroid; rows that share an identifier each count, and start in the order of their
components; fewer than k vectors give fewer centroids; ties go to the smaller number; a
cluster without vectors keeps its centroid; no vectors give no rows; a distance or inertia
beyond a long is null; columns other than the two named ones play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import map_arrow, materialize

K, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
#: Whole numbers below this are exact in float64, those below WIDE in int64.
LIMIT, WIDE = 1 << 53, 1 << 63
LONGEST = WIDE - 1


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """vec_id and its components as doubles, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    broken = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("x") == dims) & ~broken)


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """floor(scale * x): the places of rows that fit 64 bits with room to spare, these rows, and the rest as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    fits = (np.abs(y) < 2.0**62).all(axis=1)
    rest = [[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(row, floored)] for row, floored in zip(x[~fits], y[~fits])]
    return fits, y[fits].astype(np.int64), rest


def pack(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of vectors: their identifiers, and their integers as bytes, or as decimals where 64 bits don't hold them."""
    id_type = kept.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, x = batch.column("vec_id"), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            fits, narrow, rest = integers(x, scale)
            for rows, data, wide in ((fits, narrow.tobytes(), None), (~fits, None, [str(v) for row in rest for v in row])):
                if rows.any():
                    names = ids.filter(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(names)], names), pa.array([data], pa.binary()), pa.array([wide], pa.list_(pa.string()))], ["ids", "data", "wide"])

    return map_arrow(kept, run, f"ids array<{id_type}>, data binary, wide array<string>")


def block(data: bytes | None, wide: list[str] | None, dims: int) -> np.ndarray:
    """A packed block's rows: int64, or Python integers."""
    if data is not None:
        return np.frombuffer(data, np.int64).reshape(-1, dims)
    return np.array([int(v) for v in wide], object).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of its nearest centroid and its squared distance (int64, or Python integers).

    ``centroids`` are Python integers (k x dims).
    """
    reach = max(abs(v) for v in centroids.flat)
    size = np.abs(x).max(axis=1)
    dims = x.shape[1]

    def under(limit: int) -> np.ndarray:
        """Rows whose numbers all stay below the limit: dims * (max|x| + max|c|)² < limit."""
        most = 0
        while dims * (most + (1 << 30)) ** 2 < limit:
            most += 1 << 30
        for bit in range(29, -1, -1):
            if dims * (most + (1 << bit)) ** 2 < limit:
                most += 1 << bit
        return size <= most - reach

    cluster = np.zeros(len(x), np.int64)
    distance = np.zeros(len(x), object)
    exact, fits = under(LIMIT), under(WIDE)
    if exact.any():
        a, c = x[exact].astype(np.float64), centroids.astype(np.float64)
        squared = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
        cluster[exact] = squared.argmin(axis=1)
        distance[exact] = squared.min(axis=1).astype(np.int64)
    for rows, kind in ((fits & ~exact, np.int64), (~fits & ~exact, object)):
        if rows.any():
            a, c = x[rows].astype(kind), centroids.astype(kind)
            squared = np.stack([((a - one) ** 2).sum(axis=1) for one in c], axis=1)
            cluster[rows] = squared.argmin(axis=1)
            distance[rows] = squared.min(axis=1)
    return cluster, distance


def totals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one block adds to each cluster: vectors, sums of components, sum of distances; all Python integers."""
    k, dims = centroids.shape
    cluster, distance = nearest(x, centroids)
    count, sums, inertia = np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object)
    narrow = x.dtype != object and len(x) * int(np.abs(x).max(initial=0)) < WIDE
    for j in np.unique(cluster):
        mine = cluster == j
        count[j] = int(mine.sum())
        sums[j] += (x[mine] if narrow else x[mine].astype(object)).sum(axis=0).astype(object)
        inertia[j] = int(distance[mine].sum())
    return count, sums, inertia


def start(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    point = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter(F.col("vec_id").isNotNull()).select("x").orderBy(point, "x").limit(k).collect()
    found = []
    for (x,) in rows:
        fits, narrow, rest = integers(np.array([x], np.float64), scale)
        found.append([int(v) for v in narrow[0]] if fits[0] else rest[0])
    return np.array(found, object)


def lloyd(packed: DataFrame, centroids: np.ndarray, rounds: int, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after the rounds, and the inertia of each cluster under them."""
    k, dims = centroids.shape
    blocks = packed.select("data", "wide").rdd
    zero = (np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object))

    def merge(a, b):
        return tuple(x + y for x, y in zip(a, b))

    def assigned(now):
        return blocks.treeAggregate(zero, lambda held, row: merge(held, totals(block(row[0], row[1], dims), now)), merge, depth)

    for _ in range(rounds):
        count, sums, _ = assigned(centroids)
        centroids = np.array([[v // n for v in row] if n else list(old) for n, row, old in zip(count, sums, centroids)], object)
    return centroids, assigned(centroids)[2]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kept = kept_vectors(vectors, id_col, vec_col, dims)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = start(kept, k, seed, scale)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], schema)
    packed = materialize(pack(kept, dims, scale), "vectors")
    centroids, inertia = lloyd(packed, centroids, rounds)
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], pa.string())

    def held(values) -> pa.Array:
        return pa.array([int(v) if v <= LONGEST else None for v in values], pa.int64())

    of_cluster, whole = held(inertia), held([inertia.sum()])[0]

    def run(batches):
        for batch in batches:
            for ids, data, wide in zip(batch.column("ids"), batch.column("data").to_pylist(), batch.column("wide").to_pylist()):
                number, distance = nearest(block(data, wide, dims), centroids)
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, at.cast(pa.int32()), held(distance), of_cluster.take(at), pa.array([whole.as_py()] * len(at), pa.int64()), digests.take(at)],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return map_arrow(packed, run, schema)


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL: one row per vector and component, a pair of tables for each round."""
    parts = [
        f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS})""",
        "xs AS MATERIALIZED (SELECT r, unnest(v)::HUGEINT AS x, unnest(range(1, len(v) + 1)) AS d FROM rows)",
        f"firsts AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k FROM rows WHERE vec_id IS NOT NULL)",
        f"c0 AS MATERIALIZED (SELECT k, d, x AS c FROM xs JOIN firsts USING (r) WHERE k < {K})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, k, distance FROM (SELECT r, k, sum((x - c) * (x - c)) AS distance FROM xs JOIN c{n} USING (d) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""
        )
        if n < rounds:
            # Components lie far under 2^53 here, so floor() of a double quotient would do; the remainder makes it exact.
            parts.append(
                f"""s{n} AS (SELECT k, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM xs JOIN a{n} USING (r) GROUP BY k, d),
c{n + 1} AS MATERIALIZED (SELECT k, d, CASE WHEN n IS NULL THEN c ELSE (s - (((s % n) + n) % n)) // n END AS c FROM c{n} LEFT JOIN s{n} USING (k, d))"""
            )
    return f"""WITH {", ".join(parts)},
digests AS (SELECT k, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN rows USING (r) JOIN digests USING (k)"""
