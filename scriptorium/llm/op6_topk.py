"""Exact top-k inner-product search by tiles.

Queries are dealt by hash into blocks of about ``block_queries``; a block is small
enough, whatever the table holds, to go to every task.  Each task holds a tile of
candidates against a block at a time, takes one matrix product, and keeps the
``k`` best of each query in its partition.  These short lists are merged in two levels
(within groups of partitions, then across them).  Candidates are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import durable

_HIT = "query_id long, vec_id long, score long"
TILE = 4096


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def select_top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores in each row, ties to smaller ids.

    ``ids`` ascend; ``own`` is the id of each row's query, which is left out.
    """
    n = scores.shape[1]
    free = ids[None, :] != own[:, None]
    if n > 4 * k and np.abs(scores).max(initial=0) < 2**42:
        key = scores.astype(np.int64) * 2**20 + np.arange(n - 1, -1, -1)
        key[~free] = np.iinfo(np.int64).min
        best = np.argpartition(key, n - k, axis=1)[:, n - k :]
        row = np.repeat(np.arange(len(scores)), k)
        col = best.ravel()
        keep = free[row, col]
        return row[keep], col[keep]
    rows, cols = [], []
    for r in range(len(scores)):
        at = np.flatnonzero(free[r])
        at = at[np.argsort(-scores[r, at], kind="stable")[:k]]
        rows.append(np.full(len(at), r))
        cols.append(at)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact integer inner products: double where they fit 53 bits, else Python integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return queries @ tile.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(tile).T
    return np.vectorize(lambda x: min(max(x, -(2**63)), 2**63 - 1), otypes=[np.int64])(exact)


def _scan(block: list[tuple[int, list[float]]], k: int):
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(v) for _, v in block}:
        own = [(i, v) for i, v in block if len(v) == width]
        by_width[width] = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], float).reshape(len(own), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def best(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            pick = rank < k
            return q[pick], v[pick], s[pick]

        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(1))
                widths = np.array([len(v) for v in vectors])
                for width, (own, queries) in by_width.items():
                    mine = np.flatnonzero(widths == width)
                    mine = mine[np.argsort(ids[mine], kind="stable")]
                    if not len(mine):
                        continue
                    tile = np.array([vectors[i] for i in mine], float).reshape(len(mine), width)
                    for b in range(0, len(own), 512):
                        scores = _products(queries[b : b + 512], tile)
                        r, c = select_top(scores, ids[mine], own[b : b + 512], k)
                        new = own[b : b + 512][r], ids[mine][c], scores[r, c].astype(np.int64)
                        have = kept.get((width, b))
                        if len(new[0]):
                            kept[width, b] = best(*new) if have is None else best(*map(np.concatenate, zip(have, new)))
        for q, v, s in kept.values():
            yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    scale: float = 256.0,
    block_queries: int = 4096,
    merge_groups: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row.

    Components become floor(scale * x).  Candidates are all rows but those with the
    query's own id; ties go to the smaller id.  Rows with a null id, a null vector, or
    a null or non-finite component take no part; a candidate of another length than
    the query's is none of its candidates.  Rows that repeat a query's id are one query
    if their vectors are equal; with different vectors each asks for itself and the
    best k of both stay.  Scores beyond 64 bits stop at the limit of long.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = lambda v: v.cast("double") * scale
    steps = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < 2.0**53, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    usable = vectors.where(F.coalesce(fit, F.lit(False)))
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), steps.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = rows.where("asks")
    blocks = max(1, -(-asked.count() // block_queries))
    hits = []
    for b in range(blocks):  # each block is bounded and has a job of its own
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v").distinct().collect()
        if block:
            hit = rows.select("vec_id", "v").mapInArrow(_scan([tuple(r) for r in block], k), _HIT)
            hits.append(hit if blocks == 1 else durable(hit))  # the driver lets a block go before it takes the next
    if not hits:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    found = reduce(DataFrame.union, hits).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(merge_groups)))
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "lot").orderBy(*order))).where(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
