"""Operator 3, exact top-k search: a Voronoi kNN join on integer inner products.

Each vector x becomes floor(scale * x). Largest inner product turns into smallest Euclidean distance by one
more coordinate, sqrt(M^2 - |x|^2) for data and 0 for queries, with M the largest data norm. Pivots come from
a bounded hash sample, about as many as the square root of the data blocks (n_pivots to most_pivots). Every row joins its nearest pivot's cell; rows range-partitioned by (cell, distance,
id) form blocks of at most block_rows, each an annulus [near, far] around its pivot with its own summary. For
a query block (pivot p, radius r), theta bounds the k-th neighbour of each of its queries from the data
cells' summaries: r + d(p, p_j) + far, far being that of the cell's nearest block of k + 1 rows at least, as no
block behind it can lower the bound; smaller blocks count one by one. A data block is replicated to a query block
only if d(p, p_j) - r - far <= theta and near - d(p, p_j) - r <= theta, tried on whole cells first and on the
blocks of those that stay. Blocks are solved locally in exact arithmetic and partial lists merge by score, ties to
the smaller id.

A query block meets one small row per cell, not one per data block; a hot cell is many blocks, so no task holds it
whole. Blocks of vectors reach Python in batches that Spark bounds in bytes (arrow.maxBytesPerBatch). Null vectors and vectors with
null or non-finite components take no part; repeated vectors all do. Fewer than k others: all are returned.
An empty table gives an empty table. Vectors shorter than the longest take no part. Query rows that share an id give
one list, the best of them all.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.base import discard, materialize
from docquarry.llm.vectors import best, matrix, pack_rows, unpack_rows, usable

_BLOCK = "cell int, near double, far double, rows long, ids binary, vectors binary"


def _blocks(rows: DataFrame, pivots: np.ndarray, top: float, is_query: bool, block_rows: int) -> DataFrame:
    """Rows dealt to their nearest pivot and cut into blocks."""

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            if not len(v):
                continue
            extra = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(top - (v * v).sum(1), 0))
            full = np.column_stack((v, extra))
            d2 = (full * full).sum(1)[:, None] - 2 * full @ pivots.T + (pivots * pivots).sum(1)[None]
            cell = d2.argmin(1)
            dist = np.sqrt(((full - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(dist)], ["id", "v", "cell", "dist"])

    def cut(batches):
        held: list = []
        cell = None

        def out(rows):
            ids, m = pack_rows(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array([rows[0][2]], pa.int32()), pa.array([rows[0][3]]), pa.array([rows[-1][3]]), pa.array([len(rows)], pa.int64()), pa.array([ids]), pa.array([m])], ["cell", "near", "far", "rows", "ids", "vectors"])

        for batch in batches:
            v = matrix(batch.column(1))
            for i, (key, c, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if held and (c != cell or len(held) >= block_rows):
                    yield out(held)
                    held = []
                cell = c
                held.append((key, v[i], c, d))
        if held:
            yield out(held)

    placed = rows.mapInArrow(assign, "id long, v array<double>, cell int, dist double")
    return placed.repartitionByRange("cell", "dist", "id").sortWithinPartitions("cell", "dist", "id").mapInArrow(cut, _BLOCK)


def knn_join(queries: DataFrame, data: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = 32, most_pivots: int = 512, block_rows: int = 1024, query_rows: int = 256) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best other rows."""
    spark = data.sparkSession

    def quantized(df):
        return usable(df, id_col, vector_col, False).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))

    data_q = written = materialize(quantized(data))
    query_q = quantized(queries)
    out_schema = "query_id long, rank int, vec_id long, score long"
    head = data_q.agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("dim")).first()
    if head.top is None:
        discard(written)
        return spark.createDataFrame([], out_schema)
    top, dim = float(head.top), int(head.dim)
    data_q, query_q = (df.filter(F.size("v") == dim) for df in (data_q, query_q))
    wanted = min(most_pivots, max(n_pivots, isqrt(head.rows // block_rows)))
    sample = data_q.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    p = np.array([r.v for r in sample])
    pivots = np.unique(np.column_stack((p, np.sqrt(np.maximum(top - (p * p).sum(1), 0)))), axis=0)
    apart = np.array([np.sqrt(((pivots - p) ** 2).sum(1)) for p in pivots])

    stored = materialize(_blocks(data_q, pivots, top, False, block_rows).withColumn("block", F.expr("uuid()")))
    asked = materialize(_blocks(query_q, pivots, top, True, query_rows).withColumn("qblock", F.expr("uuid()")))

    # Pairs of pivots are at most most_pivots squared.
    between = [(int(i), int(j), float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    gap = F.broadcast(spark.createDataFrame(between, "q_cell int, cell int, gap double"))
    ask = asked.select("qblock", F.col("cell").alias("q_cell"), F.col("far").alias("radius"))
    summary = stored.groupBy("cell", F.col("far").alias("reach"), F.col("near").alias("inner")).agg(F.sum("rows").alias("rows"))
    # k + 1 rows: the query itself may be among them.
    cells = materialize(summary.groupBy("cell").agg(F.min(F.when(F.col("rows") > k, F.col("reach"))).alias("full"), F.max("reach").alias("reach"), F.min("inner").alias("inner")))
    heads = cells.filter("full IS NOT NULL").select("cell", F.col("full").alias("reach"), F.lit(k + 1).cast("long").alias("rows")).unionByName(summary.filter(F.col("rows") <= k).select("cell", "reach", "rows"))
    upper = F.col("radius") + F.col("gap") + F.col("reach")
    run = F.sum("rows").over(Window.partitionBy("qblock").orderBy("upper"))
    bound = ask.join(gap, "q_cell").join(heads, "cell").select("qblock", "rows", upper.alias("upper")).withColumn("held", run)
    theta = bound.groupBy("qblock").agg(F.coalesce(F.min(F.when(F.col("held") > k, F.col("upper"))), F.lit(float("inf"))).alias("theta"))
    slack = F.lit(1e-6) * (1 + F.col("gap") + F.col("radius") + F.col("reach"))
    near_enough = (F.col("gap") - F.col("radius") - F.col("reach") <= F.col("theta") + slack) & (F.col("inner") - F.col("gap") - F.col("radius") <= F.col("theta") + slack)
    met = ask.join(gap, "q_cell").join(cells, "cell").join(theta, "qblock").filter(near_enough).select("qblock", "cell", "gap", "radius", "theta")
    needed = met.join(summary, "cell").filter(near_enough).select("qblock", "cell", F.col("reach").alias("far"), F.col("inner").alias("near"))
    pairs = needed.join(stored.select("cell", "near", "far", "block", F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors")), ["cell", "near", "far"]).join(asked.select("qblock", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "qblock")

    def solve(batches):
        for batch in batches:
            for q_ids, q_raw, d_ids, d_raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                qi, q = unpack_rows(q_ids, q_raw)
                di, d = unpack_rows(d_ids, d_raw)
                exact = np.abs(q).max() * np.abs(d).max() * dim < 2**52
                scores = (q @ d.T).astype(np.int64) if exact else np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in d] for x in q], object)
                rows = []
                for r, key in enumerate(qi):
                    other = di != key
                    s, ids = scores[r][other], di[other]
                    take = best(s, ids, k)
                    rows += [(int(key), int(ids[t]), int(s[t])) for t in take]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    part = materialize(pairs.select("q_ids", "q_vectors", "d_ids", "d_vectors").mapInArrow(solve, "query_id long, vec_id long, score long"))
    for table in (written, stored, asked, cells):
        discard(table)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
