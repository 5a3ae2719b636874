"""Embedders behind a protocol, applied in batches of an Arrow pass (inventory S10-S12)."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class _Slots(dict):
    """Twice the place of a word's count, and one more where it is negative; begun again when it is large."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        self[word] = found = 2 * (h % self.dim) + (h >> 31 == 0)
        return found


class HashingEmbedder:
    """No model: signed counts of words by their checksums, of unit length (a text without words: zeros)."""

    def __init__(self, dim: int = 64):
        self.dim, self.slots = dim, _Slots(dim)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            counts = np.bincount(np.fromiter(map(self.slots.__getitem__, text.lower().split()), np.int64), minlength=2 * self.dim)
            row += counts[::2] - counts[1::2]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()


def embed(chunks: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, text: str = "text", size: int = 64) -> DataFrame:
    """chunks with embedding array<float> in place of any column of that name: one embedder a task, size texts a call.

    Null texts get null. A vector of another length than the embedder's dim fails the job.
    """
    kept = chunks.drop("embedding")
    columns = kept.columns
    place = columns.index(text)

    def run(batches):
        model = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = part.column(place).to_pylist()
                vectors = iter(model.embed([t for t in texts if t is not None]))
                rows = [None if t is None else next(vectors) for t in texts]
                if any(r is not None and len(r) != model.dim for r in rows):
                    raise ValueError(f"an embedding is not of length {model.dim}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float32()))], [*columns, "embedding"])

    return kept.mapInArrow(run, kept.withColumn("embedding", F.lit(None).cast("array<float>")).schema)
