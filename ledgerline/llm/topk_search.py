"""Exact top-k search by tiled matrix products.

Rows are packed into shards and query blocks of bounded size. Each
(block, shard) pair is one tile: a matrix product, a partial selection of k for
each query of the tile, and nothing else leaves the task. The per-tile lists
are merged as a tree: first within groups of shards, then over all.

Every query block meets every shard once (a stated query set against all rows,
in blocks). The shards are written once; the blocks are cut from them. Blocks
are broadcast while their packed size, computed from the counts, is under
``broadcast_bytes``; beyond that the blocks are dealt in rounds of bounded size,
each a separate broadcast over the same shards.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part (nor do those of which a scaled component isn't finite). Shorter
vectors are padded with zeros, so vectors of unequal length have the inner
product of their common part. Ties go to the smaller id; rows with a null id
take no part. Queries and candidates are rows: a repeated id is a query as often
as it occurs, and a candidate of its other rows. With fewer than k candidates
all are returned. Components keep the range of a double. Scores are
exact integers: products run in float64 while every partial sum is under 2^53,
else in Python integers; a score beyond the range of a long is clipped to it.
Extra columns are ignored whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

_LONG = (-(1 << 63), (1 << 63) - 1)


def _pack(rows: int, width: int):
    """Batches to packed matrices (float64) of at most ``rows`` rows. A row's
    number is unique in the table that the shards are written to."""

    def fn(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, asked = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            flat, off = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            off = off - off[0]
            for lo in range(0, b.num_rows, rows):
                hi = min(lo + rows, b.num_rows)
                own = ids[lo:hi]
                m = np.zeros((hi - lo, width))
                n = np.diff(off[lo : hi + 1])
                r = np.repeat(np.arange(hi - lo), n)
                m[r, np.arange(off[lo], off[hi]) - np.repeat(off[lo:hi], n)] = np.floor(flat[off[lo] : off[hi]])
                order = np.argsort(own, kind="stable")
                packed = [own[order].astype("<i8"), m[order], asked[lo:hi][order].astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["shard", "ids", "mat", "asked"])
                number += hi - lo

    return fn


def _blocks(rows: int, width: int):
    """The asked rows of shards as packed blocks of at most ``rows`` rows."""

    def fn(batches):
        for b in batches:
            for shard, ids, mat, asked in zip(*(b.column(c).to_pylist() for c in ("shard", "ids", "mat", "asked"))):
                at = np.flatnonzero(np.frombuffer(asked, np.uint8))
                own, m = np.frombuffer(ids, "<i8")[at], np.frombuffer(mat).reshape(-1, width)[at]
                for lo in range(0, len(at), rows):
                    part = [shard + at[lo : lo + rows].astype("<i8"), own[lo : lo + rows], m[lo : lo + rows]]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in part], ["q_rows", "q_ids", "q_mat"])

    return fn


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two integer-valued matrices."""
    top = np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1]
    if top < 2**53:
        return (q @ m.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in m], object).T
    return np.clip(exact, *_LONG).astype(np.int64)


def _tile(k: int, width: int):
    def fn(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for shard, qrows, qids, qmat, ids, mat in zip(*(b.column(c).to_pylist() for c in ("shard", "q_rows", "q_ids", "q_mat", "ids", "mat"))):
                ri, qi, vi = np.frombuffer(qrows, "<i8"), np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                s = product(np.frombuffer(qmat).reshape(len(qi), width), np.frombuffer(mat).reshape(len(vi), width))
                for r, q, row in zip(ri.tolist(), qi.tolist(), s):
                    v, own = vi, r - shard
                    if 0 <= own < len(vi):  # the query's own row
                        v, row = np.delete(vi, own), np.delete(row, own)
                    if len(row) > k:  # ids ascend, so the first of the tied rows win
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        over = np.flatnonzero(row > least)
                        at = np.concatenate((over, np.flatnonzero(row == least)[: k - len(over)]))
                        v, row = v[at], row[at]
                    for x, y in zip(out, ([r] * len(v), [q] * len(v), v.tolist(), row.tolist(), [shard] * len(v))):
                        x += y
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_row", "query_id", "vec_id", "score", "shard"])

    return fn


def _best(df: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int = 4096, block_rows: int = 512, fan_in: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``df`` for each row of
    ``df`` where ``is_query`` (a Column over ``id_col``) holds, by the inner
    product of the vectors floor(scale * x)."""
    spark = df.sparkSession
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    whole = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), x.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_asked"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull()).where(whole)
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    rows = rows.select("_id", F.transform("_v", lambda c: c * scale).alias("_v"), "_asked")
    dealt = rows.repartition(shuffle_partitions(spark), "_id")
    shards = cut(dealt.mapInArrow(_pack(shard_rows, width), "shard long, ids binary, mat binary, asked binary"), "shards")
    blocks = cut(shards.mapInArrow(_blocks(block_rows, width), "q_rows binary, q_ids binary, q_mat binary"), "blocks")
    size = blocks.agg(F.sum(F.octet_length("q_mat") + 2 * F.octet_length("q_ids"))).first()[0] or 0
    rounds = max(1, -(-size // broadcast_bytes))
    out = None
    for turn in range(rounds):
        part = blocks if rounds == 1 else blocks.where(F.pmod(F.xxhash64("q_rows"), F.lit(rounds)) == turn)
        tiles = shards.select("shard", "ids", "mat").crossJoin(F.broadcast(part)).mapInArrow(_tile(k, width), "query_row long, query_id long, vec_id long, score long, shard long")
        tiles = tiles.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(fan_in)))
        out = tiles if out is None else out.unionAll(tiles)
    merged = _best(out, k, "query_row", "group").drop("rank")
    return _best(merged, k, "query_row").select("query_id", "rank", "vec_id", "score")
