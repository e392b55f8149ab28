"""Nearest neighbours by cosine: a block matrix join with int8 product tiles and exact re-scoring.

Candidates are dealt into blocks by hash and queries into blocks; each pair of blocks meets in one task.
There, unit vectors are quantised to int8 with their own scale; a tile of integer products gives every
cosine up to a proven bound (norms of the quantisation errors). Pairs whose upper bound reaches the
k-th lower bound are re-scored in double precision on the original vectors and kept in a heap per
query; the heaps of all blocks are merged. The result is exact.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an
id, take no part; vectors meet only vectors of their own dimension; exactly repeated rows count once; a
query never meets its own id; ties go to the smaller id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 2048
#: Bytes of vectors in a block, and the most and least candidates and the most queries in one.
BLOCK_BYTES, MOST, LEAST, QUERIES = 16 << 20, 32_768, 1024, 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norm of what the codes miss, for rows of length 1."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products in double precision, summed from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def thin(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``keep`` rows, those with the smallest ids, of each exactly equal vector, an id once: no other copy can be among a query's nearest."""
    seen: dict[bytes, tuple[int, int]] = {}
    rows = []
    for i in np.argsort(ids, kind="stable").tolist():
        n, last = seen.get(key := vectors[i].tobytes(), (0, -1))
        if n < keep and (n == 0 or last != ids[i]):
            seen[key] = n + 1, int(ids[i])
            rows.append(i)
    return ids[rows], vectors[rows]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of the ``k`` nearest in this block."""
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    ids, vectors = thin(ids, vectors, k + 1)
    q_codes, q_scale, q_err = quantise(unit(queries))
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for at in range(0, len(ids), TILE):
        own, part = ids[at : at + TILE], vectors[at : at + TILE]
        codes, scale, err = quantise(unit(part))
        near = (q_codes.astype(exact) @ codes.T.astype(exact)).astype(np.float64) * q_scale[:, None] * scale[None, :]
        slack = q_err[:, None] + (1 + q_err[:, None]) * err[None, :] + 1e-9
        same = query_ids[:, None] == own[None, :]
        low = np.where(same, -np.inf, near - slack)
        high = np.where(same, -np.inf, near + slack)
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(query_ids), -np.inf)
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
        row, column = np.nonzero((high >= floor[:, None]) & ~same)
        for start in range(0, len(row), 65536):
            r, c = row[start : start + 65536], column[start : start + 65536]
            for i, j, s in zip(r.tolist(), own[c].tolist(), cosines(queries[r], part[c]).tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -j))
                elif (s, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -j))
    return [(q, -j, s) for q, heap in zip(query_ids.tolist(), heaps, strict=True) for s, j in heap]


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists(v, lambda x: x != 0.0)


def block_counts(n: int, q: int, dim: int, tasks: int) -> tuple[int, int]:
    """How many blocks of candidates and of queries: as few as memory allows, as each copies the other side, but enough for all tasks."""
    room = max(64, BLOCK_BYTES // (8 * max(dim, 1)))
    wide = -(-n // LEAST)
    return max(1, -(-n // min(MOST, room)), min(wide, 2 * tasks)), max(1, -(-q // min(QUERIES, room)))


def nearest(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 5, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest cosine for each row where ``is_query`` holds.

    Vectors travel in their own type. Each task returns ``k`` rows a query; of these the best are kept before the shuffle
    and after it. ``blocks``: numbers of blocks of candidates and queries, else from the sizes.
    """
    spark = df.sparkSession
    kind = "array<float>" if df.select(vector).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast(kind).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")
    )
    rows = rows.withColumn("_dim", F.size("_v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_q").alias("q"), F.max("_dim").alias("dim")).first()
    blocks, query_blocks = blocks or block_counts(sizes.n, sizes.q, sizes.dim or 1, spark.sparkContext.defaultParallelism)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    left = rows.select("_id", "_v", "_dim", place(blocks).alias("_c"), numbers(query_blocks).alias("_b"))
    right = rows.where("_q").select("_id", "_v", "_dim", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("_b"), numbers(blocks).alias("_c"))

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        matrix = lambda t: np.array(t["_v"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        found = search_block(asked["_id"].to_numpy(), matrix(asked), some["_id"].to_numpy(), matrix(some), k) if some.num_rows and asked.num_rows else []
        found = sorted(set(found))
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    keys = ["_c", "_b", "_dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
