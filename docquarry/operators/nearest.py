"""Exact nearest rows by cosine: blocks of queries meet blocks of data, shard by shard.

All pairs are scored, in matrix products over Arrow batches; the rows near enough to a query's k-th are scored again in
the order of the vector's components, so that scores and ties are those of the plain fold. A task holds two blocks and k
rows a query; the query blocks go once to every shard, whose number is fixed, so the shuffle grows with the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = "shard int, block long, dim int, ids binary, vectors binary"
_PAIR = "query_id long, id long, score double"


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of their components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _packed(rows: DataFrame, size: int, shards: int) -> DataFrame:
    """Blocks of rows(id, v) of one length. Vectors that are null, empty, zero or hold nulls have no score and go."""

    def pack(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            nonlocal made
            ids, vs = (np.concatenate(x) for x in held.pop(dim))
            made += 1
            number = task * 7919 + made
            return pa.RecordBatch.from_arrays([pa.array([number % shards], pa.int32()), pa.array([(task << 32) + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vs.tobytes()], pa.binary())], ["shard", "block", "dim", "ids", "vectors"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            for dim in np.unique(lengths):
                of = np.flatnonzero(lengths == dim)
                m = flat[starts[of][:, None] + np.arange(dim)]
                for at in range(0, len(of), size):
                    a, b = held.setdefault(int(dim), ([], []))
                    a.append(ids[of[at : at + size]])
                    b.append(m[at : at + size])
                    if sum(map(len, a)) >= size:
                        yield out(int(dim))
        for dim in list(held):
            yield out(dim)

    v = F.col("v").cast("array<double>")
    usable = F.col("id").isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull()) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.filter(usable).select(F.col("id").cast("long").alias("id"), v.alias("v")).mapInArrow(pack, _BLOCK)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of each query's k best rows of a block; ties to the smaller id, a score that is no number first."""
    with np.errstate(all="ignore"):
        q_norm, d_norm = np.sqrt(_fold(q, q)), np.sqrt(_fold(d, d))
        near = q @ d.T
        near /= q_norm[:, None]
        near /= d_norm
        if not (np.isfinite(q_norm).all() and np.isfinite(d_norm).all() and (q_norm > 1e-100).all() and (d_norm > 1e-100).all()):
            near[~np.isfinite(near)] = np.inf
        if others:
            for i in np.flatnonzero(np.isin(q_ids, d_ids)):
                near[i, d_ids == q_ids[i]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
        # Both sums are off by about one rounding a component at most, of products that add up to the norms' product at most.
        slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps
        rows, cols = np.nonzero((near >= least[:, None] - slack) & (near > -np.inf))
        score = np.empty(len(rows))
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            under = q_norm[r] * d_norm[c]
            score[at : at + (1 << 16)] = np.where(under == 0, -np.inf, _fold(d[c], q[r]) / under)
    held = score > -np.inf
    held |= np.isnan(score)
    return best_rows(rows[held], d_ids[cols[held]], score[held], k)


def best_rows(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of (row, id, score)."""
    order = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score), rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return rows[keep], ids[order][keep], score[order][keep]


def nearest(data: DataFrame, queries: DataFrame, k: int, others: bool, shards: int = 48, data_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """(query_id, id, score) of data(id, v) and queries(id, v): each shard's k best rows of every query, to be ranked over the shards.

    others: a row is no neighbour of a query of its id. Vectors of different lengths have no score.
    """
    stored = _packed(data, data_rows, shards).select("shard", "dim", F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors"))
    asked = _packed(queries, query_rows, shards).drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # A merge join deals pairs by shard and lists them query block by query block.
    pairs = asked.hint("merge").join(stored, ["shard", "dim"]).select("shard", "block", "dim", "ids", "vectors", "d_ids", "d_vectors")

    def solve(batches):
        key, ids, found = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids[found[0]], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, dim = (batch.column(c)[i].as_py() for c in range(3))
                if key != (shard, block):
                    if key is not None and len(found[0]):
                        yield out()
                    key, ids = (shard, block), np.frombuffer(batch.column(3)[i].as_buffer(), "<i8").copy()
                    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    q = np.frombuffer(batch.column(4)[i].as_buffer(), "<f8").reshape(-1, dim).copy()
                d_ids = np.frombuffer(batch.column(5)[i].as_buffer(), "<i8")
                d = np.frombuffer(batch.column(6)[i].as_buffer(), "<f8").reshape(-1, dim)
                new = best_of_block(ids, q, d_ids, d, k, others)
                found = best_rows(*(np.concatenate(x) for x in zip(found, new)), k)
        if key is not None and len(found[0]):
            yield out()

    return pairs.mapInArrow(solve, _PAIR)
