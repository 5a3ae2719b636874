"""Helpers shared by the training-data operators: table reads, cut lineage, batch slicing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at once; texts may be long, and the default of 10,000 is made for short rows.
BATCH_ROWS = 1000
_libc = ctypes.CDLL(None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named (tests, one machine), one beside the warehouse, which executors share too."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-docquarry"
        if not spark.sparkContext.master.startswith("local") and at.startswith(("file:", "/")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table in the shared folder; survives lost executors.

    Spark removes the write's own shuffle files as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{uuid.uuid4().hex}"
    schema = df.schema
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._docquarry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._docquarry_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_filters(spark: SparkSession):
    """Let Spark build its own Bloom filters (bounded by its creationSideThreshold and maxNumBits) for joins of a
    selective small table with a large scan of any size, so that rows without a partner are not shuffled."""
    return setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text is about max_bytes in all; one longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    off = offsets_of(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task, idle beside the next one's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def as_text(arr: pa.Array) -> pa.Array:
    """A compact large_string array without nulls (null: empty), its own text from byte 0 on."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    arr = arr.fill_null("") if arr.null_count else arr
    raw = arr.buffers()[2]
    if not len(arr) or raw is None:
        return arr
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    if off[0] == 0:
        return arr
    return pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer((off - off[0]).tobytes()), raw.slice(int(off[0]), int(off[-1] - off[0])))


def offsets_of(arr: pa.Array) -> np.ndarray:
    arr = as_text(arr)
    return np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, offsets of the rows in them from 0)."""
    arr = as_text(arr)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def list_array(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(flat, kind))


def binary_array(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of raw little-endian bytes; offsets count elements of flat."""
    raw = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def append_columns(df: DataFrame, text_col: str, fields: str, compute, max_bytes: int = 1 << 20) -> DataFrame:
    """df with more columns, made by compute(text array) -> Arrow arrays; rows and other columns pass through.

    A column of df that has the name of a new one is replaced.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    kept = df.drop(*names)
    columns = kept.columns
    place = columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, place, max_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part.column(place))], [*columns, *names])

    from pyspark.sql.types import StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(fields).fields]))


def bounded_sample(df: DataFrame, keys: list[str], bound: int, rows: int | None = None) -> DataFrame:
    """About bound rows chosen by a hash of keys, all if there are fewer; where keys repeat, of those at most 2 * bound, least hashes first. No rows to the driver."""
    from pyspark.sql import functions as F

    rows = df.count() if rows is None else rows
    if rows <= bound:
        return df
    wide = 1 << 30
    place = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(wide))
    return df.filter(place < int(wide * bound / rows)).orderBy(place, *keys).limit(2 * bound)
