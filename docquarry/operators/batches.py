"""Arrow passes in bounded pieces: groups one after another, texts a few at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 20
PIECE_ROWS = 8192


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def values(column: pa.Array) -> list:
    """A column's values; nulls of numbers with a point are no numbers."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(column.type) else column.to_pylist()


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column number text holds about PIECE_CHARS bytes at most, one row at least."""
    at = held = 0
    for i in range(batch.num_rows):
        value = batch.column(text)[i]
        size = value.as_buffer().size if value.is_valid else 0
        if i > at and (held + size > PIECE_CHARS or i - at >= PIECE_ROWS):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def by_group(rows: DataFrame, keys: list[str], order: str, make: Callable[[list[tuple]], list[tuple]], text: str) -> DataFrame:
    """make's rows, of the same columns, for the rows of each group in order, nulls last: one sorted pass, a group at a time."""
    names = rows.columns
    n_keys, of, schema = [names.index(k) for k in keys], names.index(text), rows.schema

    def run(batches):
        key, held, out, chars, kinds = None, [], [], 0, None

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kinds = batch.schema.types
            for part in pieces(batch, of):
                for row in zip(*map(values, part.columns)):
                    k = [row[i] for i in n_keys]
                    if held and k != key:
                        made = make(held)
                        out += made
                        chars += sum(len(r[of] or "") for r in made)
                        held = []
                        if chars > PIECE_CHARS or len(out) > PIECE_ROWS:
                            yield packed(out)
                            out, chars = [], 0
                    key = k
                    held.append(row)
            release()
        out += make(held) if held else []
        if out:
            yield packed(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last()).mapInArrow(run, schema)
