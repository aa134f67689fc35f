"""Nearest vectors by a block matrix join in int8 (operator 7).

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one tile of a distributed matrix product.  Vectors are scaled to int8;
the length of what rounding leaves of each vector bounds the error of every
approximate distance, so a candidate whose least possible distance is over the
k-th greatest possible one of its tile cannot be among the nearest.  Survivors are
recomputed in double precision from the original vectors.  A tile keeps at most
k candidates for each query; bounded heaps merge tiles, first inside each task,
then by query.  Results are exact, not sampled: no candidate is dropped but by
its bound.

int8 products are summed in float32, which is exact below 2^24 (up to 1000
dimensions); wider vectors use float64.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different dimension are never compared; an
id that repeats counts once, with its nearest vector, and as a query with its
least vector; equal distances go to the smaller id; with fewer candidates than k
all are listed; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import register

K = 10
QUERY_ROWS = 2048  # queries in a block, about
TILE_ROWS = 8192  # candidates in a block, about
AT_ONCE = 256  # queries of a tile whose bounds are held at once


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components only, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of -127 to 127, scale, length of the rounding error) of each row."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1.0  # far below the tile's greatest value: the row is all rounding error
    q = np.rint(x / scale[:, None])
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed from the first component to the last (scaled where squares leave the range of doubles)."""
    if not len(rows):
        return np.zeros(0)
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(np.cumsum((rows - one) ** 2, axis=1)[:, -1])
    odd = ~((d > 1e-140) & (d < 1e150))
    if odd.any():
        power = int(np.frexp(max(np.abs(rows[odd]).max(), np.abs(one).max()))[1])
        d[odd] = np.ldexp(np.sqrt(np.cumsum((np.ldexp(rows[odd], -power) - np.ldexp(one, -power)) ** 2, axis=1)[:, -1]), power)
    return d


def tile_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, distance) of the k nearest candidates of each query, by bounds first."""
    exact = np.float32 if q.shape[1] <= 1000 else np.float64
    # bounds are taken on values scaled by a power of two, so that no square overflows or vanishes
    power = -int(np.frexp(max(np.abs(q).max(), np.abs(c).max()))[1])
    by_id = np.argsort(cid, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(cid[by_id])) + 1]
    cq, cs, ce = quantised(np.ldexp(c, power))
    c_norm, cq = (cq * cq).sum(1) * cs * cs, cq.astype(exact)
    out = []
    for i in range(0, len(q), AT_ONCE):
        ids, part = qid[i:i + AT_ONCE], q[i:i + AT_ONCE]
        pq, ps, pe = quantised(np.ldexp(part, power))
        dots = (pq.astype(exact) @ cq.T).astype(np.float64) * ps[:, None] * cs
        near = np.sqrt(np.maximum(((pq * pq).sum(1) * ps * ps)[:, None] + c_norm - 2 * dots, 0))
        error = (pe[:, None] + ce) * (1 + 1e-9) + 1e-9 * (1 + near)
        own = ids[:, None] == cid
        # the k-th bound over distinct ids: a repeated id counts once, with its nearest row
        upper = np.minimum.reduceat(np.where(own, np.inf, near + error)[:, by_id], starts, axis=1)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(starts) > k else np.full(len(ids), np.inf)
        alive = ~own & ~(near - error > limit[:, None])  # a bound that is no number prunes nothing
        for row, query in enumerate(ids):
            at = np.flatnonzero(alive[row])
            d = distances(c[at], part[row])
            order = np.lexsort((cid[at], d))
            _, first = np.unique(cid[at][order], return_index=True)
            out += [(query, cid[at[j]], d[j]) for j in order[np.sort(first)[:k]]]
    return out


def keep_nearest(heap: list[tuple], score: float, vec: int, k: int) -> None:
    """Keep the k smallest (score, id) in a heap with the worst one on top."""
    item = (-score, -vec)
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _merged(pairs: DataFrame, k: int, ranked: bool) -> DataFrame:
    """Bounded heaps over the rows of each task: k rows a query and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple]] = {}
        for b in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keep_nearest(heaps.setdefault(query, []), score, vec, k)
        rows = [(query, rank, -v, -s) for query, heap in heaps.items()
                for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        cols = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)]
        names = ["query_id", "rank", "vec_id", "score"]
        if not ranked:
            del cols[1], names[1]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    rank = "rank INT, " if ranked else ""
    return pairs.select("query_id", "vec_id", "score").mapInArrow(run, f"query_id BIGINT, {rank}vec_id BIGINT, score DOUBLE")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            query_rows: int = QUERY_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other vectors of each query row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          is_query.alias("q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // tile_rows)), max(1, -(-n_queries // query_rows))
    rows = rows.withColumn("dim", F.size("v"))
    queries = (rows.filter("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
               .withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    # a repeated row counts once, however often it occurs
    candidates = (rows.select("id", "v", "dim").dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
                  .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>"))))
    tile = ["dim", "query_block", "block"]

    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = tile_nearest(q["id"].to_numpy(), np.stack(q["v"]), c["id"].to_numpy(), np.stack(c["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    pairs = (queries.select("id", "v", *tile).groupBy(*tile)
             .cogroup(candidates.select("id", "v", *tile).groupBy(*tile))
             .applyInPandas(product, "query_id BIGINT, vec_id BIGINT, score DOUBLE"))
    # an id with several vectors may come out of several tiles: its nearest one counts
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _merged(_merged(pairs, k, ranked=False).repartition("query_id"), k, ranked=True)


@register("op7_int8_block_join", sql=f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= {K}""")
def op7(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
