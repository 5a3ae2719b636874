"""Operator 2, substring dedup: passages that recur across documents, by collinear chaining of seeds.

1. Seeds: closed syncmers, the k-word runs whose least-hashed word stands first or last. Which runs these are
   hangs on their own words alone, so two texts that share a run share its seed, and k - 1 runs in sequence hold one
   at least: the seeds of an exactly shared stretch touch or overlap each other.
2. Join: each seed's first occurrence (least row) leads; every occurrence in other rows is matched with it alone,
   so a passage in n places makes n - 1 matches at most, whatever n is. The first occurrence comes from an
   aggregation with map-side combine; the join back is one that adaptive execution can split. Seeds go through in
   slices of their hashes, which bounds the shuffle files on disk.
3. Chains: the matches of a row with one leader, as blocks of unbroken runs along a diagonal, in order of both
   positions; a Fenwick tree over leader positions holds the best chain end before a place, gap costs are linear in
   the words skipped on both sides.
4. Windows: where seeds recur one after another but leader or diagonal changes, every window of min_words words of
   the stretch is a seed too, led by the first row that holds all of it: unbroken runs of them are passages at once.
5. Alignment: chains are widened, and further, in rounds, on sides that still match at the edge; the
   words of both sides are fetched, and aligned along the chain's diagonals, +1 a match, -2 a mismatch, with a
   cost to change diagonal and a break where the score drops by more than DROP; all passages of min_words at least,
   with min_identity of words equal, are returned.

So every exact passage of min_words + 2 * (k - 2) words is found, whoever leads its seeds, but for k - 2 words at most at
its edges; a shorter one too, unless an earlier row leads all its seeds in place and lacks an outer word. One with edits
needs two seeds in common with a first holder (README: measured recall).

A row is known by its id and a checksum of its text: rows of one id but other texts are matched and cut each for
itself, in the order of the checksum; rows equal in both count as one. A row is never matched with itself, but may be with
one of its id. Null ids take no part; null, empty and short texts have no seeds. Extra columns pass through
remove_passages; an empty table gives an empty table. Places in a text take 27 bits, rows 36; more raises an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import bytes_of, discard, join_filters, list_array, materialize, slices
from docquarry.llm.wordhash import _SPACE, ngrams, words

_PLACE = 27  # bits of a word's place; those above hold the row's number
_NUMBER, _TASK = 23, 13  # a row's number: its place in a task, and the task
PASSAGES = "doc_id long, start_word long, n_words long, other_doc_id long, other_start_word long, matches long, text_crc int"
DROP = 40
SLICES = 4  # a power of two: seeds of one slice share the top bits of their hashes


def checksums(texts: pa.Array) -> np.ndarray:
    """31-bit checksums of the rows' bytes."""
    data, off = bytes_of(texts)
    raw = memoryview(data)
    return np.fromiter((zlib.crc32(raw[a:b]) & 0x7FFFFFFF for a, b in zip(off[:-1].tolist(), off[1:].tolist())), np.int64, len(off) - 1)


def seeds(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of each row's closed syncmers, every occurrence."""
    h, off = words(texts)
    g, at = ngrams(h, off, k)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        np.minimum(least, h[i : len(h) - k + 1 + i], out=least)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
    first = off[row_of] + np.arange(len(g)) - at[row_of]
    chosen = np.flatnonzero((h[first] == least[first]) | (h[first + k - 1] == least[first]))
    row = row_of[chosen]
    return row, chosen - at[row], g[chosen]


def numbered(rows: DataFrame) -> DataFrame:
    """(rid, id, crc) of distinct rows(id, crc): numbers of 36 bits in the order of (id, crc)."""

    def count(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            if task >> _TASK or (n + batch.num_rows) >> _NUMBER:
                raise ValueError("more rows than row numbers: raise spark.sql.shuffle.partitions, up to 8192")
            yield pa.RecordBatch.from_arrays([pa.array((task << _NUMBER) + n + np.arange(batch.num_rows)), *batch.columns], ["rid", "id", "crc"])
            n += batch.num_rows

    spread = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << _TASK)
    return rows.repartitionByRange(spread, "id", "crc").sortWithinPartitions("id", "crc").mapInArrow(count, "rid long, id long, crc int")


def changes(row: np.ndarray, pos: np.ndarray, lead: np.ndarray, diagonal: np.ndarray, k: int, size: int) -> list[tuple[int, int, int]]:
    """(row, from, to): starts of the windows in each stretch of touching seeds that have several leaders or diagonals.

    The arrays: a row's recurring seeds. Ranges may reach over the text's ends.
    """
    order = np.lexsort((pos, row))
    row, pos, lead, diagonal = row[order], pos[order], lead[order], diagonal[order]
    near = k - 1
    breaks = np.flatnonzero((row[1:] != row[:-1]) | (pos[1:] - pos[:-1] > near)) + 1
    first = np.concatenate(([0], breaks))
    last = np.concatenate((breaks, [len(pos)])) - 1
    stretch = np.searchsorted(first, np.arange(len(pos)), side="right") - 1
    other = (lead[1:] != lead[:-1]) | (diagonal[1:] != diagonal[:-1])
    mixed = np.unique(stretch[1:][other & (stretch[1:] == stretch[:-1])])
    lo, hi = pos[first[mixed]] - near + 1, pos[last[mixed]] + k + near - size
    return [(r, a, b) for r, a, b in zip(row[first[mixed]].tolist(), lo.tolist(), hi.tolist()) if b > a]


def windows(texts: pa.Array, ranges: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, hash) of the size-word windows that start in the rows' ranges.

    Of copies that overlap each other (periodic text) one in size words stays, and the last.
    """
    h, off = words(texts)
    g, first = ngrams(h, off, size)
    rows = [np.arange(max(0, a), min(b, int(n))) + at for spans, at, n in zip(ranges, first[:-1], np.diff(first)) for a, b in spans]
    chosen = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.searchsorted(first, chosen, side="right") - 1
    value = g[chosen]
    order = np.lexsort((chosen, value, row))
    row, value, pos = row[order], value[order], (chosen - first[row])[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1]) | (pos[1:] - pos[:-1] >= size)
    head = pos[np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))] if len(pos) else pos
    tile = (pos - head) // size
    kept = fresh.copy()
    kept[1:] |= tile[1:] != tile[:-1]
    kept[:-1] |= fresh[1:]
    kept[-1:] = True
    return row[kept], pos[kept], value[kept]


def still_equal(a: np.ndarray, b: np.ndarray, diagonals: list[int], n: int) -> tuple[bool, bool]:
    """Whether half of the first n words, and of the last, that lie inside both are equal on some diagonal."""
    left = right = False
    for d in diagonals:
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        if hi > lo:
            equal = a[lo:hi] == b[lo + d : hi + d]
            left |= 2 * int(equal[:n].sum()) >= len(equal[:n])
            right |= 2 * int(equal[-n:].sum()) >= len(equal[-n:])
    return left, right


def chains(x: np.ndarray, y: np.ndarray, size: np.ndarray, gap: float, least: float, far: int) -> list[np.ndarray]:
    """Places of the blocks of each chain; block i spans size[i] words from x[i] and y[i].

    best(i) = size_i + max(0, max over blocks j that end before i on both sides of best(j) - gap * (words between on
    both sides)); a chain breaks where more than far words lie between on either side.
    """
    xe, ye = x + size, y + size
    rank = np.unique(ye, return_inverse=True)[1] + 1
    below = np.searchsorted(np.unique(ye), y, side="right").tolist()  # ends at or before this start
    top_rank = int(rank.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (top_rank + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    xs, ys, ws, rs = x.tolist(), y.tolist(), size.tolist(), rank.tolist()
    # Ends come before starts at the same place: a block may begin where another ends.
    events = sorted([(int(e), 0, i) for i, e in enumerate(xe)] + [(s, 1, i) for i, s in enumerate(xs)])
    for _, start, i in events:
        if start:
            at, top = below[i], (-np.inf, -1)
            while at > 0:
                if tree[at] > top:
                    top = tree[at]
                at &= at - 1
            here = gap * (xs[i] + ys[i])
            score[i] = ws[i]
            if top[0] - here > 0:
                score[i], before[i] = ws[i] + top[0] - here, top[1]
        else:
            held = (score[i] + gap * (xs[i] + ys[i] + 2 * ws[i]), i)
            at = rs[i]
            while at <= top_rank:
                if held > tree[at]:
                    tree[at] = held
                at += at & -at
    used = [False] * len(x)
    found = []
    for i in sorted(range(len(x)), key=lambda i: -score[i]):
        path = []
        j = i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        path = path[::-1]
        far_apart = [n for n in range(1, len(path)) if max(xs[path[n]] - xe[path[n - 1]], ys[path[n]] - ye[path[n - 1]]) > far]
        for part in np.split(np.array(path, np.int64), far_apart):
            if len(part):
                between = (x[part[-1]] - x[part[0]]) + (y[part[-1]] - y[part[0]]) - 2 * size[part[:-1]].sum()
                if size[part].sum() - gap * between >= least:
                    found.append(part)
    return found


def align(a: np.ndarray, b: np.ndarray, diagonals: list[int], mismatch: float = -2, jump: float = -4, floor: float = 0) -> tuple[int, int, int, int, int]:
    """The best local alignment along the diagonals (b's place minus a's): (a start, a end, b start, b end, matches).

    One that scores less than floor need not be found.
    """
    n = len(a)
    places = np.arange(n)[:, None] + np.array(diagonals)[None]
    inside = (places >= 0) & (places < len(b))
    equal = inside & (b[np.clip(places, 0, max(len(b) - 1, 0))] == a[:, None]) if len(b) else inside & False
    if len(diagonals) == 1:
        gain = np.where(equal[:, 0], 1, mismatch)
        total = np.concatenate(([0], np.cumsum(gain)))
        low = np.minimum.accumulate(total)
        end = int((total - low).argmax())
        # The last lowest place before the end starts the segment.
        start = end - int(total[: end + 1][::-1].argmin()) if end else 0
        d = diagonals[0]
        inner = total[start : end + 1]
        fall = np.maximum.accumulate(inner) - inner
        if fall.max() > DROP:  # the better side of the deepest fall
            low = int(fall.argmax())
            peak = int(inner[:low].argmax())
            sides = [(lo, hi, align(a[lo:hi], b, [d + lo], mismatch, jump)) for lo, hi in ((start, start + peak), (start + low, end))]
            lo, hi, best = max(sides, key=lambda x: x[2][4] + mismatch * (x[2][1] - x[2][0] - x[2][4]))
            return best[0] + lo, best[1] + lo, *best[2:]
        return start, end, start + d, end + d, int(equal[start:end, 0].sum())
    # The score that every word equal on any diagonal would give: none scores more, and where it is 0 all begin anew.
    total = np.concatenate(([0.0], np.cumsum(np.where(equal.any(1), 1.0, mismatch))))
    bound = total - np.minimum.accumulate(total)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], bound[1:] > 0, [False])).astype(np.int8)))
    tops = np.maximum.reduceat(np.append(bound[1:], 0), edges)[::2] if len(edges) else edges
    best, first = (0, 0, 0, 0, 0, 0), n
    for z in np.argsort(-tops, kind="stable").tolist():
        lo, hi = int(edges[2 * z]), int(edges[2 * z + 1])
        if tops[z] < max(floor - 1e-6, best[0]):
            break
        here = _along(equal[lo:hi].tolist(), lo, diagonals, mismatch, jump)
        if here[0] > best[0] or (here[0] == best[0] and lo < first):
            best, first = here, lo
    return best[1:]


def _along(rows: list, at: int, diagonals: list[int], mismatch: float, jump: float) -> tuple[float, int, int, int, int, int]:
    """(score, a start, a end, b start, b end, matches) of the best alignment in rows of words equal by diagonal, the first of them word at."""
    count = len(diagonals)
    score, begin = [0] * count, [(at, at + d) for d in diagonals]
    hits, peak = [0] * count, [0] * count
    best = (0, 0, 0, 0, 0, 0)
    for i, row in enumerate(rows, at):
        top = max(range(count), key=score.__getitem__)
        s_top, b_top, h_top, p_top = score[top], begin[top], hits[top], peak[top]
        for c in range(count):
            s, from_, h, most = score[c], begin[c], hits[c], peak[c]
            if c != top and s_top + jump > s:
                s, from_, h, most = s_top + jump, b_top, h_top, p_top
            if s <= 0 or most - s > DROP:
                s, from_, h, most = 0, (i, i + diagonals[c]), 0, 0
            if row[c]:
                s, h = s + 1, h + 1
            else:
                s += mismatch
            score[c], begin[c], hits[c], peak[c] = s, from_, h, max(most, s)
            if s > best[0]:
                best = (s, from_[0], i + 1, from_[1], i + 1 + diagonals[c], h)
    return best


def segments(a: np.ndarray, b: np.ndarray, diagonals: list[int], min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """All passages along the diagonals, as align() gives them: the best, then those left and right of it.

    A segment below min_identity is aligned again at the mismatch cost at which a positive score is that identity.
    """
    ratio = -min_identity / (1 - min_identity) if min_identity < 1 else -float(len(a) + 1)
    found = []
    todo = [(0, len(a), diagonals, 0)]
    while todo:
        lo, hi, along, level = todo.pop()
        if hi - lo < min_words:
            continue
        cost = min(-2, ratio) if level else -2
        if level == 1:
            cost += 0.5 / len(a)  # of exactly min_identity: positive
        # No passage scores less than this, and none here more than the best.
        least = max(1e-9, min_words * (min_identity + cost * (1 - min_identity)) - 4 * (len(along) - 1))
        a0, a1, b0, b1, same = align(a[lo:hi], b, [d + lo for d in along], cost, floor=least)
        n = a1 - a0
        if not n or same + cost * (n - same) < least:
            continue
        a0, a1 = a0 + lo, a1 + lo
        todo += [(lo, a0, along, level), (a1, hi, along, level)]
        if n >= min_words:
            if same >= min_identity * max(n, b1 - b0):
                found.append((a0, a1, b0, b1, same))
            elif level == 0:
                todo.append((a0, a1, along, 1))
            elif level == 1:
                todo += [(a0, a1, [d], 2) for d in along]  # jumps made the other side too long
    return sorted(found)


def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(rid, row, place, leader's place, leader) of the matches of a batch (rid, m: pos, lead)."""
    lists = batch.column(1)
    flat = lists.flatten()
    x, lead = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    rid = batch.column(0).to_numpy()
    return rid, np.repeat(np.arange(len(rid)), np.diff(np.asarray(lists.offsets))), x, lead & ((1 << _PLACE) - 1), lead >> _PLACE


def runs(rid: np.ndarray, row: np.ndarray, x: np.ndarray, y: np.ndarray, lead: np.ndarray, step: int, size: int) -> tuple[np.ndarray, ...]:
    """Matches with other rows, in order of row, leader, diagonal and place, with the starts and words of their unbroken runs, and where a pair of rows ends."""
    mine = lead != rid[row]
    row, x, y, lead = row[mine], x[mine], y[mine], lead[mine]
    order = np.lexsort((x, y - x, lead, row))
    row, x, y, lead = row[order], x[order], y[order], lead[order]
    pair = (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])
    fresh = np.concatenate(([True], pair | ((y - x)[1:] != (y - x)[:-1]) | (x[1:] - x[:-1] > step)))[: len(x)]
    at = np.flatnonzero(fresh)
    width = (x[np.append(at[1:], len(x)) - 1] - x[at] if len(at) else at) + size
    return row, x, y, lead, at, width, pair


def exact(size: int):
    """A function from batches of matched windows to passages: unbroken runs of windows; in periodic text, each window that stands for others."""

    def run(batches):
        for batch in batches:
            rid, *found = opened(batch)
            row, x, y, lead, at, width, _ = runs(rid, *found, 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rid[row[at]], x[at], width, lead[at], y[at], width)], [f.split()[0] for f in _FOUND.split(", ")[:6]])

    return run


def linker(k: int, size: int, least: float, gap: float, far: int, slack: int, grid: int):
    """A function from batches (rid, m: pos, lead) to rows: links (s1 .. diagonals) and ranges of windows (wide)."""

    def run(batches):
        for batch in batches:
            rid, row, x, y, lead = opened(batch)
            wide: list[list] = [[] for _ in rid]
            for r, lo, hi in changes(row, x, lead, y - x, k, size) if len(x) else []:
                wide[r].append({"lo": lo, "hi": hi})
            row, x, y, lead, at, width, pair = runs(rid, row, x, y, lead, k - 1, k)
            bx, by = x[at], y[at]
            starts = np.flatnonzero(np.concatenate(([True], pair))[: len(x)][at])
            ends = np.append(starts[1:], len(at))
            alone = ends - starts == 1
            kept = starts[alone & (width[starts] >= least)]
            links = [(at[j], bx[j], bx[j] + width[j], by[j], by[j] + width[j], [int(by[j] - bx[j])]) for j in kept.tolist()]
            for lo, hi in zip(starts[~alone].tolist(), ends[~alone].tolist()):
                for path in chains(bx[lo:hi], by[lo:hi], width[lo:hi], gap, least, far):
                    path = path + lo
                    links.append((at[lo], bx[path].min(), (bx[path] + width[path]).max(), by[path].min(), (by[path] + width[path]).max(), np.unique(by[path] - bx[path]).tolist()))
            if links:
                place, x0, x1, y0, y1 = (np.array(v) for v in list(zip(*links))[:5])
                diagonals = pa.array([v[5] for v in links], pa.list_(pa.int64()))
                none = pa.nulls(len(links), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[row[place]]), pa.array(np.maximum(0, x0 - slack)), pa.array(x1 + slack), pa.array(lead[place]), pa.array(np.maximum(0, y0 - slack) // grid * grid), pa.array(-(-(y1 + slack) // grid) * grid), diagonals, none],
                    _LINK_NAMES,
                )
            if told := [i for i, w in enumerate(wide) if w]:
                columns = [pa.array(rid[told]), *[pa.nulls(len(told), pa.int64())] * 5, pa.nulls(len(told), pa.list_(pa.int64())), pa.array([wide[i] for i in told], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, _LINK_NAMES)

    return run


_PAIR = "rid long, s1 long, e1 long, lid long, s2 long, e2 long, diagonals array<long>"
_LINK = f"{_PAIR}, wide array<struct<lo:long,hi:long>>"
_LINK_NAMES = [f.split()[0] for f in _PAIR.split(", ")] + ["wide"]
#: A row of an alignment is a passage, or a pair of spans to look at again, wider.
_FOUND = f"row long, start_word long, n_words long, other long, other_start_word long, matches long, {_PAIR}"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 6, min_words: int = 50, min_identity: float = 0.8, gap: float = 0.1, far: int = 100) -> DataFrame:
    """One row (PASSAGES) for each passage that a row shares with an earlier one; text_crc tells rows of one id apart."""
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slack, grid, shift = 16, 16, np.uint64(64 - SLICES.bit_length() + 1)
    names = _LINK_NAMES[:-1]

    def find(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                row, pos, value = seeds(part.column(1), k)
                if len(pos) and int(pos.max()) >> _PLACE:
                    raise ValueError("a text of more than 2**27 words")
                columns = [part.column(0), pa.array(checksums(part.column(1)), pa.int32())]
                of = value >> shift
                for i in range(SLICES):
                    mine = of == i
                    ends = np.concatenate(([0], np.cumsum(np.bincount(row[mine], minlength=part.num_rows))))
                    columns += [list_array(value[mine].view(np.int64), ends, pa.int64()), list_array(pos[mine], ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "crc", *(f"{c}{i}" for i in range(SLICES) for c in "hp")])

    lists = ", ".join(f"h{i} array<long>, p{i} array<int>" for i in range(SLICES))
    scanned = materialize(base.mapInArrow(find, f"id long, crc int, {lists}"))
    rows = materialize(numbered(scanned.select("id", "crc").distinct()))

    spent: list[DataFrame] = []

    def led(seed: DataFrame) -> DataFrame:
        """(p, lead) of each occurrence of a seed of several rows: its row and place, and those of the first; that one too."""
        lead = seed.groupBy("h").agg(F.min("p").alias("lead"), F.max("p").alias("last")).filter(F.shiftright("lead", _PLACE) < F.shiftright("last", _PLACE))
        # Written, so that the join reads plain shuffles, of which adaptive execution splits a hot seed's.
        spent.append(materialize(lead.select("h", "lead")))
        return seed.join(spent[-1], "h").select("p", "lead")

    def clear(*tables: DataFrame) -> None:
        for table in (*tables, *spent):
            discard(table)
        spent.clear()

    def gathered(matches: DataFrame) -> DataFrame:
        # Bounded by a row's own seeds; a set, for rows that are equal.
        pos = F.col("p").bitwiseAND((1 << _PLACE) - 1).cast("int")
        return matches.groupBy(F.shiftright("p", _PLACE).alias("rid")).agg(F.collect_set(F.struct(pos.alias("pos"), "lead")).alias("m"))

    def packed(pos: str):
        return (F.shiftleft("rid", _PLACE) + F.col(pos)).alias("p")

    parts = []
    for i in range(SLICES):
        seed = scanned.filter(F.size(f"h{i}") > 0).select("id", "crc", f"h{i}", f"p{i}").join(rows, ["id", "crc"]).select("rid", F.inline(F.arrays_zip(F.col(f"h{i}").alias("h"), F.col(f"p{i}").alias("pos")))).select("h", packed("pos"))
        # Written, as it is read twice, by the aggregate and by the join back.
        seed = materialize(seed)
        parts.append(materialize(led(seed)))
        clear(seed)
    discard(scanned)
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionByName(part)
    told = materialize(gathered(matches).mapInArrow(linker(k, min_words, 2.0 * k, gap, far, slack, grid), _LINK))
    clear(*parts)

    def mine(batches, act):
        """act on the parts of batches (id, text, crc, ..) less the rows of these ids with other texts."""
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                part = part.filter(pa.array(checksums(part.column(1)) == part.column(2).to_numpy()))
                if part.num_rows:
                    yield act(part)

    def fill(part):
        row, pos, value = windows(part.column(1), [[(s["lo"], s["hi"]) for s in spans] for spans in part.column(4).to_pylist()], min_words)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), part.column(3).take(pa.array(row)), pa.array(pos, pa.int64())], ["h", "rid", "pos"])

    asked = materialize(told.filter("wide is not null").select("rid", "wide").join(rows, "rid"))
    with join_filters(docs.sparkSession):
        wanted = asked.filter("id > -9223372036854775808")  # where Spark's join filter looks for a condition
        filled = materialize(base.join(wanted, "id").select("id", "text", "crc", "rid", "wide").mapInArrow(lambda batches: mine(batches, fill), "h long, rid long, pos long"))
    passages = materialize(gathered(led(filled.select("h", packed("pos")))).mapInArrow(exact(min_words), ", ".join(_FOUND.split(", ")[:6])))
    linked = materialize(told.filter("wide is null").select(*names))
    clear(told, asked, filled)

    def cut(part):
        h, off = words(part.column(1))
        rids, ss, es, out = [], [], [], []
        for i, (rid, spans) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
            own = (h[off[i] : off[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            for span in spans:
                rids.append(rid)
                ss.append(span["s"])
                es.append(span["e"])
                out.append(own[span["s"] : span["e"]])
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ss, pa.int64()), pa.array(es, pa.int64()), list_array(np.concatenate(out), np.concatenate(([0], np.cumsum([len(o) for o in out]))), pa.int32())], ["rid", "s", "e", "words"])

    types = [pa.list_(pa.int64()) if f.startswith("diagonals") else pa.int64() for f in _FOUND.split(", ")]

    def compare(batches):
        for batch in batches:
            done, more = [], []
            rid, s1, e1, lid, s2, e2, diagonals = (batch.column(i).to_pylist() for i in range(7))
            for i, along in enumerate(diagonals):
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (7, 8))
                d = [x - s2[i] + s1[i] for x in along]
                left, right = still_equal(a, b, d, 16)
                left &= s1[i] > 0 and s2[i] > 0
                right &= len(a) == e1[i] - s1[i] and len(b) == e2[i] - s2[i]
                if left or right:
                    by = max(64, 3 * (e1[i] - s1[i]))
                    more.append((rid[i], max(0, s1[i] - left * by), e1[i] + right * by, lid[i], max(0, s2[i] - left * by) // grid * grid, -(-(e2[i] + right * by) // grid) * grid, along))
                else:
                    done += [(rid[i], s1[i] + a0, a1 - a0, lid[i], s2[i] + b0, same) for a0, a1, b0, b1, same in segments(a, b, d, min_words, min_identity)]
            for kept, before in ((done, 0), (more, 6)):
                if kept:
                    own = dict(enumerate(zip(*kept), before))
                    yield pa.RecordBatch.from_arrays([pa.array(own[j], t) if j in own else pa.nulls(len(kept), t) for j, t in enumerate(types)], [f.split()[0] for f in _FOUND.split(", ")])

    def aligned(linked: DataFrame) -> DataFrame:
        spans = linked.select("rid", F.col("s1").alias("s"), F.col("e1").alias("e")).unionByName(linked.select(F.col("lid").alias("rid"), F.col("s2").alias("s"), F.col("e2").alias("e"))).distinct()
        # A row's distinct spans: bounded by its chains as a follower, and by its grid as a leader.
        asked = materialize(spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")).join(rows, "rid"))
        with join_filters(docs.sparkSession):
            wanted = asked.filter("id > -9223372036854775808")
            held = base.join(wanted, "id").select("id", "text", "crc", "rid", "spans").mapInArrow(lambda batches: mine(batches, cut), "rid long, s long, e long, words array<int>")
            # Equal rows give equal spans. Written, so that the joins below read plain shuffles, which can be split.
            held = materialize(held.groupBy("rid", "s", "e").agg(F.first("words").alias("words")))
        left = held.select("rid", F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("words").alias("a"))
        right = held.select(F.col("rid").alias("lid"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("words").alias("b"))
        both = linked.join(left, ["rid", "s1", "e1"]).join(right, ["lid", "s2", "e2"]).select(*names, "a", "b")
        out = materialize(both.mapInArrow(compare, _FOUND))
        for table in (asked, held, linked):
            discard(table)
        return out

    done = aligned(linked)
    while True:
        some = done.filter("row is not null").select("row", "start_word", "n_words", "other", "other_start_word", "matches")
        passages = passages.unionByName(some)
        if done.filter("rid is not null").isEmpty():
            break
        done = aligned(materialize(done.filter("rid is not null").select(*names).distinct().repartition("rid")))
    own = rows.select(F.col("rid").alias("row"), F.col("id").alias("doc_id"), F.col("crc").alias("text_crc"))
    first = rows.select(F.col("rid").alias("other"), F.col("id").alias("other_doc_id"))
    return passages.distinct().join(own, "row").join(first, "other").select(*[c.split()[0] for c in PASSAGES.split(", ")])


def _without(text: bytes, spans: list) -> str:
    """text less the words of the spans (start, words) and the white space after them."""
    data = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[data]
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    gone = np.zeros(len(start) + 1, bool)
    for s, n in spans:
        gone[s : min(s + n, len(start))] = True
    edges = np.append(start, len(data))
    keep = [text[: edges[0]]] if len(start) else [text]
    change = np.flatnonzero(np.diff(np.concatenate(([True], gone[: len(start)], [True])).astype(np.int8)))
    for lo, hi in zip(change[::2], change[1::2]):
        keep.append(text[edges[lo] : edges[hi]])
    return b"".join(keep).decode("utf-8").rstrip() if gone.any() else text.decode("utf-8")


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages, each cut from the rows of its doc_id and text_crc; the earlier row keeps its copy. No row goes."""
    spans = passages.groupBy(F.col("doc_id").alias("__dq_id"), F.col("text_crc").cast("long").alias("__dq_crc")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("__dq_spans"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFFF)
    marked = docs.withColumn("__dq_id", F.col(id_col).cast("long")).withColumn("__dq_crc", crc).join(spans, ["__dq_id", "__dq_crc"], "left")
    columns = docs.columns
    place = columns.index(text_col)

    def cut(batches):
        for batch in batches:
            spans_of = batch.column(len(columns)).to_pylist()
            if any(spans_of):
                texts = batch.column(place).to_pylist()
                new = [_without(t.encode("utf-8"), [(s["start_word"], s["n_words"]) for s in sp]) if sp and t is not None else t for t, sp in zip(texts, spans_of)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == place else batch.column(i) for i in range(len(columns))], columns)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))], columns)

    return marked.select(*columns, "__dq_spans").mapInArrow(cut, docs.schema)
