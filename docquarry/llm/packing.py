"""Operator 4, packing: documents into sequences of at most 2048 tokens, balanced by attention cost.

A document's ids are cut: full sequences first, and a remainder. Remainders are dealt by hash into groups
of about group_docs, and each group is packed alone. Within a group, remainders in descending length go to
the sequence of lowest estimated cost (linear * tokens + quadratic * sum of squared piece lengths) that has
room; with ceil(tokens / capacity) sequences open, what fits nowhere whole is cut to fill the gaps, so a
group pads at most one sequence. Null and empty texts pack as their end id; rows with repeated ids are
packed each, equal rows dealt to different groups; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import binary_array, list_array, slices
from docquarry.llm.bpe import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, bin, offset). Descending items go to the cheapest bin with room; leftovers are cut."""
    total = int(sizes.sum())
    bins = -(-total // capacity)
    used = np.zeros(bins, np.int64)
    heap = [(0.0, b) for b in range(bins)]
    pieces, rest = [], []
    for item in np.argsort(-sizes, kind="stable"):
        n = int(sizes[item])
        if not n:
            continue
        tried = []
        while heap:
            cost, b = heapq.heappop(heap)
            if used[b] + n <= capacity:
                pieces.append((int(item), 0, n, b, int(used[b])))
                used[b] += n
                if used[b] < capacity:
                    tried.append((cost + linear * n + quadratic * n * n, b))
                break
            tried.append((cost, b))
            if len(tried) >= 64:  # the cheapest bins are all too full: look at every open one
                fits = [x for x in heap if used[x[1]] + n <= capacity]
                if not fits:
                    rest.append(int(item))
                    break
                cost, b = min(fits)
                heap.remove((cost, b))
                heapq.heapify(heap)
                pieces.append((int(item), 0, n, b, int(used[b])))
                used[b] += n
                if used[b] < capacity:
                    tried.append((cost + linear * n + quadratic * n * n, b))
                break
        else:
            rest.append(int(item))
        for x in tried:
            heapq.heappush(heap, x)
    gaps = iter(sorted(np.flatnonzero(used < capacity), key=lambda b: used[b] - capacity))
    b = next(gaps, None)
    for item in rest:
        done = 0
        while done < sizes[item]:
            n = int(min(sizes[item] - done, capacity - used[b]))
            pieces.append((item, done, n, int(b), int(used[b])))
            used[b] += n
            done += n
            if used[b] == capacity:
                b = next(gaps, None)
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_docs: int = 4096, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row for each piece (PIECES). Reads the texts once; only remainders are shuffled, at most 4 bytes an id."""
    groups = max(1, -(-docs.count() // group_docs))

    def encode(batches):
        # Equal rows are told apart by their place among their equals in the task, so a row's group does not hang on row order.
        equals: dict[tuple, int] = {}
        here = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, off = encoder(tokenizer_path).encode(part.column(1))
                rows = [np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4") for i in range(part.num_rows)]
                sizes = np.array([len(r) for r in rows], np.int64)
                whole = sizes // capacity
                crcs = np.array([zlib.crc32(r[j * capacity : (j + 1) * capacity]) for r, w in zip(rows, whole) for j in range(w)], np.int64)
                tails = [r[w * capacity :] for r, w in zip(rows, whole)]
                tail_off = np.concatenate(([0], np.cumsum([len(t) for t in tails])))
                whole_crcs = [zlib.crc32(r) for r in rows]
                salts = []
                for key in zip(part.column(0).to_pylist(), whole_crcs):
                    equals[key] = equals.get(key, -1) + 1
                    salts.append(here | equals[key])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), list_array(crcs, np.concatenate(([0], np.cumsum(whole))), pa.int64()), binary_array(np.concatenate(tails), tail_off), pa.array(whole_crcs, pa.int64()), pa.array(salts, pa.int64())],
                    ["doc_id", "doc_tokens", "full_crcs", "tail", "crc", "salt"],
                )

    def place(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        keys = [table.column(c).combine_chunks().to_pylist() for c in ("doc_id", "doc_tokens", "full_crcs", "tail")]
        order = sorted(range(len(keys[0])), key=lambda i: (keys[0][i] is None, keys[0][i] or 0, keys[1][i], keys[3][i]))
        doc, tokens, fulls, tails = ([k[i] for i in order] for k in keys)
        tails = [np.frombuffer(t, "<u4") for t in tails]
        out: list[tuple] = []
        base = group << 32
        serial = 0
        for i, crcs in enumerate(fulls):
            for j, crc in enumerate(crcs):
                out.append((doc[i], j * capacity, capacity, crc, tokens[i], base + serial, 0))
                serial += 1
        for i, start, n, b, at in balance(np.array([len(t) for t in tails], np.int64), capacity, linear, quadratic):
            out.append((doc[i], len(fulls[i]) * capacity + start, n, zlib.crc32(tails[i][start : start + n]), tokens[i], base + serial + b, at))
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded = read.mapInArrow(encode, "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, crc long, salt long")
    dealt = coded.withColumn("grp", F.pmod(F.xxhash64("doc_id", "crc", "salt"), F.lit(groups)))
    return dealt.drop("crc", "salt").groupBy("grp").applyInArrow(place, PIECES)
