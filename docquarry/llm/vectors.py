"""Blocks of vectors, shared by the two nearest-neighbour operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, drop_zero: bool) -> DataFrame:
    """(id, v array<double>) of rows whose vector is not null and holds finite components only."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.col(id_col).isNotNull() & (F.size(v) > 0)
    if drop_zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return df.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def pack_rows(ids: np.ndarray, m: np.ndarray) -> tuple[bytes, bytes]:
    return np.ascontiguousarray(ids, "<i8").tobytes(), np.ascontiguousarray(m, "<f8").tobytes()


def unpack_rows(ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    return keys, np.frombuffer(m, "<f8").reshape(len(keys), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
