"""Operator 5, approximate nearest neighbours: low-dimensional stable projections in kd-trees.

Rows are dealt by hash into shards; each shard holds its vectors and a kd-tree over m Gaussian (2-stable)
projections. Largest inner product turns into smallest distance by one more coordinate, sqrt(M^2 - |x|^2).
A query walks a shard's tree with a heap, so that leaves come up in ascending projected distance, and verifies their vectors exactly. The
squared projected distance of a point at distance d is d^2 times a chi-square variable with m degrees of
freedom, so once the next leaf lies at projected distance r and the k-th best verified distance is d_k, any
unseen nearer point is missed with probability at most 1 - F_m(r^2 / d_k^2); the walk stops when F_m >= tau.

Every row is indexed; only the pass over the stated query set is in blocks against the shards. Null and zero
vectors and vectors with null or non-finite components take no part. Fewer than k others: all are returned
(the walk cannot stop before it has k). Ties go to the smaller id. An empty table gives an empty table. Vectors shorter
than the longest take no part. Query rows that share an id give one list, the best of them all.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.base import materialize
from docquarry.llm.vectors import matrix, pack_rows, unpack_rows, usable


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For even m: 1 - exp(-x/2) * sum of (x/2)^i / i! below m/2."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def kd_tree(p: np.ndarray, leaf: int, fan: int = 4) -> tuple[list[np.ndarray], np.ndarray]:
    """(places of the rows in each leaf, nodes). A cell splits at the median of its widest side; 2 ** fan cells share a parent.

    nodes: rows (first child, end of children) in level order, the root first; a leaf's is (-1 - leaf, 0).
    """
    leaves: list[np.ndarray] = []
    nodes = [[0, 0]]
    todo = [(0, np.arange(len(p)))]
    while todo:
        node, at = todo.pop(0)
        if len(at) <= leaf:
            nodes[node] = [-1 - len(leaves), 0]
            leaves.append(at)
            continue
        cells = [at]
        for _ in range(fan):
            split = []
            for c in cells:
                if len(c) <= leaf:
                    split.append(c)
                    continue
                axis = int(np.ptp(p[c], axis=0).argmax())
                half = len(c) // 2
                order = c[np.argpartition(p[c, axis], half)]
                split += [order[:half], order[half:]]
            cells = split
        nodes[node] = [len(nodes), len(nodes) + len(cells)]
        todo += [(len(nodes) + i, c) for i, c in enumerate(cells)]
        nodes += [[0, 0] for _ in cells]
    return leaves, np.array(nodes, np.int64)


def boxes(p: np.ndarray, leaves: list[np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest projections below each node."""
    low, high = np.empty((len(nodes), p.shape[1])), np.empty((len(nodes), p.shape[1]))
    for i in range(len(nodes) - 1, -1, -1):
        first, end = nodes[i]
        low[i] = p[leaves[-1 - first]].min(0) if first < 0 else low[first:end].min(0)
        high[i] = p[leaves[-1 - first]].max(0) if first < 0 else high[first:end].max(0)
    return low, high


def walk(q: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[float, int]]:
    """(squared projected distance, leaf) of a tree's leaves, nearest first; nodes are opened only when they come up."""
    heap = [(0.0, 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        first, end = nodes[node]
        if first < 0:
            yield bound, int(-1 - first)
            continue
        away = np.maximum(np.maximum(low[first:end] - q, q - high[first:end]), 0)
        for i, d in enumerate((away * away).sum(1).tolist(), int(first)):
            heapq.heappush(heap, (d, i))


def projected_search(q_full: np.ndarray, q_proj: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, full: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray, k: int, m: int, tau: float):
    """(query place, row places) of each query's k best within one shard."""
    square = (full * full).sum(1)
    for r in range(len(q_full)):
        own = float(q_full[r] @ q_full[r])
        seen_at, seen_d = np.zeros(0, np.int64), np.zeros(0)
        step, held, last = 4, [], 0.0
        for bound, x in itertools.chain(walk(q_proj[r], nodes, low, high), [(np.inf, -1)]):
            if len(held) >= step or x < 0:
                # Verified a few leaves at a time, in growing rounds: the test costs more than a leaf.
                rows = np.concatenate(held) if held else np.zeros(0, np.int64)
                rows = rows[ids[rows] != q_ids[r]]
                d = np.maximum(own + square[rows] - 2 * (full[rows] @ q_full[r]), 0)
                if len(d) > 4 * k:
                    near = d <= np.partition(d, k)[k]
                    rows, d = rows[near], d[near]
                seen_at, seen_d = np.concatenate((seen_at, rows)), np.concatenate((seen_d, d))
                keep = np.lexsort((ids[seen_at], seen_d))[:k]
                seen_at, seen_d = seen_at[keep], seen_d[keep]
                held, step, last = [], 2 * step, bound
                if len(seen_d) >= k:
                    d2 = seen_d.max()
                    if (d2 <= 0 < bound) or (d2 > 0 and chi_square_cdf(last / d2, m) >= tau):
                        break
            if x >= 0:
                held.append(np.arange(ends[x], ends[x + 1]))
        yield r, seen_at


def ann_search(queries: DataFrame, data: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", m: int = 16, tau: float = 0.9, shard_rows: int = 8192, leaf: int = 32, query_rows: int = 256, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found, by largest inner product."""
    spark = data.sparkSession
    rows = usable(data, id_col, vector_col, True)
    head = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"), F.max(F.size("v")).alias("dim")).first()
    if not head.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top, dim = float(head.top), int(head.dim)
    rows = rows.filter(F.size("v") == dim)
    shards = -(-head.n // shard_rows)
    plane = np.random.default_rng(seed).standard_normal((dim + 1, m))

    def lift(v, is_query):
        extra = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(top - (v * v).sum(1), 0))
        return np.column_stack((v, extra))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        full = lift(matrix(table.column("v")), False)
        p = full @ plane
        leaves, nodes = kd_tree(p, leaf)
        order = np.concatenate(leaves)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in leaves]))).astype("<i8")
        low, high = boxes(p, leaves, nodes)
        packed = pack_rows(ids[order], full[order])
        return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int64()), *(pa.array([b], pa.binary()) for b in (*packed, nodes.astype("<i8").tobytes(), low.astype("<f8").tobytes(), high.astype("<f8").tobytes(), ends.tobytes()))], ["shard", "ids", "full", "nodes", "low", "high", "ends"])

    def gather(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        packed = pack_rows(table.column("id").to_numpy()[order], matrix(table.column("v"))[order])
        return pa.Table.from_arrays([pa.array([b], pa.binary()) for b in packed], ["q_ids", "q_vectors"])

    index = materialize(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, ids binary, full binary, nodes binary, low binary, high binary, ends binary"))
    asked_rows = usable(queries, id_col, vector_col, True).filter(F.size("v") == dim)
    asked_blocks = max(1, -(-asked_rows.count() // query_rows))
    asked = materialize(asked_rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(asked_blocks))).groupBy("block").applyInArrow(gather, "q_ids binary, q_vectors binary"))
    pairs = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).join(index, "shard")

    def search(batches):
        for batch in batches:
            for q_ids, q_raw, ids, raw, nodes, low, high, ends in zip(*(batch.column(i).to_pylist() for i in range(8))):
                qi, q = unpack_rows(q_ids, q_raw)
                di, full = unpack_rows(ids, raw)
                bounds = [np.frombuffer(x, "<f8").reshape(-1, m) for x in (low, high)]
                lifted = lift(q, True)
                out = []
                for r, at in projected_search(lifted, lifted @ plane, qi, di, full, np.frombuffer(nodes, "<i8").reshape(-1, 2), *bounds, np.frombuffer(ends, "<i8"), k, m, tau):
                    scores = (full[at, :dim] * q[r]).sum(1)
                    out += [(int(qi[r]), int(di[a]), float(s)) for a, s in zip(at, scores)]
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = pairs.select("q_ids", "q_vectors", "ids", "full", "nodes", "low", "high", "ends").mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
