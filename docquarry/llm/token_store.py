"""Operator 7, token-ID output: documents' ids as zstandard frames under one shared dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample (sample_docs, by hash order of the
ids; the only sampled thing). Each document is one frame, so a short document can be read alone. Documents
are range-partitioned and sorted by id; runs of them form container files of about shard_tokens ids, written
through Spark's committed writer (so a lost executor's part is written again) as one row a container:

    magic b"DQTS" | version u16 | id width u16 | documents u32 | dictionary hash 32 bytes | offsets u64 x (documents + 1) | frames

The hash names the dictionary, which lies beside the containers. A reader refuses another dictionary.
Null and empty texts hold the end id alone; null ids come first; repeated ids keep one frame each, next to one another
in the order of a hash of their texts; a very long text is one long frame; an empty table gives no container and no row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.base import bounded_sample, shared_dir, slices
from docquarry.llm.bpe import encoder

_HEAD = struct.Struct("<4sHHI32s")
MAGIC, VERSION = b"DQTS", 1


def pack_container(frames: list[bytes], width: int, dictionary_hash: bytes) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    return b"".join((_HEAD.pack(MAGIC, VERSION, width, len(frames), dictionary_hash), offsets.tobytes(), *frames))


class Container:
    """Random access to the documents of one container."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, version, self.width, self.count, digest = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token container of this version")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the container was written with another dictionary")
        at = _HEAD.size
        self.offsets = np.frombuffer(raw, "<u8", self.count + 1, at)
        self.body = memoryview(raw)[at + 8 * (self.count + 1) :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.reader.decompress(self.body[int(self.offsets[i]) : int(self.offsets[i + 1])])
        return np.frombuffer(raw, f"<u{self.width}")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw) if raw else zstandard.ZstdCompressionDict(b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, sample_docs: int, dictionary_bytes: int, width: int) -> bytes:
    """About sample_docs short serialized arrays (at most 4096 ids, of the first 16384 characters, each) reach the driver."""

    def serialize(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                ids, off = encoder(tokenizer_path).encode(part.column(0))
                rows = [np.append(ids[off[i] : min(off[i + 1], off[i] + 4095)], end_id).astype(f"<u{width}").tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    begun = docs.select("id", F.xxhash64("text").alias("tie"), F.coalesce(F.substring("text", 1, 16384), F.lit("")).alias("text"))
    sample = bounded_sample(begun, ["id", "tie"], sample_docs).select("text")
    rows = [bytes(r.ids) for r in sample.repartition(8).mapInArrow(serialize, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, rows).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: no dictionary
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, sample_docs: int = 2000, dictionary_bytes: int = 1 << 16, level: int = 3) -> None:
    """Write containers in ascending id order under path/containers, the dictionary under path/dictionary."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, sample_docs, dictionary_bytes, width)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(digest), bytearray(dictionary))], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def contain(batches):
        writer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=False)
        held_ids: list[int] = []
        frames: list[bytes] = []
        counts: list[int] = []
        size = 0
        part_no = _partition()
        serial = 0

        def flush():
            nonlocal held_ids, frames, counts, size, serial
            row = pa.RecordBatch.from_arrays(
                [pa.array([part_no * (1 << 32) + serial], pa.int64()), pa.array([size], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([pack_container(frames, width, digest)], pa.binary())],
                ["shard", "tokens", "doc_ids", "doc_tokens", "container"],
            )
            held_ids, frames, counts, size, serial = [], [], [], 0, serial + 1
            return row

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, off = encoder(tokenizer_path).encode(part.column(1))
                for i, key in enumerate(part.column(0).to_pylist()):
                    raw = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype(f"<u{width}").tobytes()
                    frames.append(writer.compress(raw))
                    held_ids.append(key)
                    counts.append(len(raw) // width)
                    size += counts[-1]
                    if size >= shard_tokens:
                        yield flush()
        if frames:
            yield flush()

    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange(partitions, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    made = ordered.mapInArrow(contain, "shard long, tokens long, doc_ids array<long>, doc_tokens array<long>, container binary")
    made.write.option("compression", "none").parquet(f"{path}/containers")


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) from the written files; start counts the ids of all documents before."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    written = spark.read.parquet(f"{path}/containers")
    # Places in the id order: of the tasks that wrote, one row each, then of a task's containers.
    held = written.select("shard", F.shiftright("shard", 32).alias("task"), "tokens")
    before = lambda window: F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = held.groupBy("task").agg(F.sum("tokens").alias("tokens")).select("task", before(Window.orderBy("task")).alias("base"))
    within = held.withColumn("first", before(Window.partitionBy("task").orderBy("shard")))
    begins = within.join(tasks, "task").select("shard", (F.col("first") + F.col("base")).alias("first"))

    def decode(batches):
        for batch in batches:
            for shard, first, keys, counts, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                box = Container(raw, dictionary)
                starts = first + np.cumsum(counts) - counts
                found = [box[i].astype("<u4") for i in range(box.count)]
                sizes = [len(x) for x in found]
                if sizes != counts:
                    raise ValueError(f"container {shard} does not hold what its index says")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    placed = written.select("shard", "doc_ids", "doc_tokens", "container").join(begins, "shard")
    return placed.select("shard", "first", "doc_ids", "doc_tokens", "container").mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_output(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **options) -> DataFrame:
    """Write the documents' ids, read the files back, and return the digest of each document."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/docquarry/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, id_col=id_col, text_col=text_col, **options)
    return read_tokens(spark, path).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
