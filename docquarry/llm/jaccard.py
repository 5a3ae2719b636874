"""Operator 9, n-gram Jaccard join: exact components by adaptive multi-match prefixes.

Rows with equal shingle sets collapse into one class by two 64-bit set hashes. Two sets of Jaccard >= t share
at least o = ceil(t * n) of either's n shingles, so under any order of all shingles the first n - o + l of each
hold at least l shared ones (l-match prefixes).

1. Partition filter: similar sets differ in at most d = (1 - t) / t * n shingles, n the smaller size. Sizes fall
   into geometric classes; within one, hash ranges cut every set into 1.25 d + 1 parts. Similar sets have all
   but d of them in common, so each has at least (parts - d - its own empty parts) parts, not empty, that some
   other set has too; classes with fewer go. Parts are compared as hashes, in passes over slices of them, which
   bounds the shuffle files on disk. A part holds several shingles, so texts that only share phrases do not
   meet here, however large the corpus.
2. For the classes left, shingles are counted exactly. A shingle of one class alone can match nothing, so a
   class with more than n - o of them goes. Order by (frequency, hash), rarest first; each class lengthens its
   prefix to the l whose estimated cost, sum(frequency - 1) / l, is least.
3. Prefix postings give candidates. First every class is verified against the least-edited member of its lists
   (linear in the postings), and linked classes merge. Then only pairs of different components are listed,
   those of the largest component of a list only against the others, with at least min(l, l') shared prefix
   shingles; these are verified too. Verification intersects whole sets. So no link between components is
   missed, and no group is expanded into all its pairs.

Fewer than k words: the whole sequence is one shingle. Without words or text: empty set, linked with nothing.
Rows with a null id are returned without component and take no part. Repeated rows share their class. Ties,
very long texts and empty tables need no care; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import discard, join_filters, list_array, materialize, slices
from docquarry.llm.components import connected_components
from docquarry.llm.wordhash import mix, shingle_sets


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    one = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
    two = np.array([int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-n * num // den)


_BOUNDS = [1]
while _BOUNDS[-1] < 1 << 40:
    _BOUNDS.append(max(_BOUNDS[-1] + 1, _BOUNDS[-1] * 3 // 2))
_BOUNDS = np.array(_BOUNDS)
PASSES = 4
SPARE = 4  # a quarter more parts than can differ
_CLASS_BITS = 127  # the low bits of a part's hash name its size class


def part_hashes(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """(hashes of the non-empty parts of a sorted set, class + 128 * parts needed), for each class that a similar smaller set may be of."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), []
    value, out, needs = mix(s), [], []
    first, last = np.searchsorted(_BOUNDS, (needed(n, num, den), n), side="right") - 1
    for c in range(first, last + 1):
        apart = int(_BOUNDS[c + 1] - 1) * (den - num) // num
        if not apart:
            continue
        parts = apart + 1 + apart // SPARE
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        h = mix(np.add.reduceat(value, begin) + at[begin] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(c) << 40))
        out.append((h & ~np.uint64(_CLASS_BITS)) | np.uint64(c))
        needs.append(int(c) + 128 * max(0, parts - apart - (parts - len(begin))))
    return (np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)), needs


def class_columns(k: int):
    """For append_columns: n_shingles and the set's hashes."""

    def compute(texts):
        sets = shingle_sets(texts, k)
        one, two = set_hashes(sets)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)]

    return compute


CLASS_FIELDS = "__dq_n long, __dq_s1 long, __dq_s2 long"


def _classes(base: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, n, s1, s2, parts, needs), (classes: rid, first_id, n, s1, s2)."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                sets = shingle_sets(part.column(1), k)
                one, two = set_hashes(sets)
                pre, needs = zip(*(part_hashes(s, num, den) for s in sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), list_array(np.concatenate(pre), np.concatenate(([0], np.cumsum([len(p) for p in pre]))), pa.int64()), pa.array(list(needs), pa.list_(pa.int64()))],
                    ["id", "n", "s1", "s2", "parts", "needs"],
                )

    seen = materialize(base.mapInArrow(scan, "id long, n long, s1 long, s2 long, parts array<long>, needs array<long>"))
    classes = seen.filter("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("first_id"))
    return seen, materialize(classes.withColumn("rid", F.monotonically_increasing_id()))


def _candidates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 1: (rid, first_id, s1, s2) of the classes that stay."""
    keys = ["n", "s1", "s2", "first_id"]
    named = rows.withColumnRenamed("id", "first_id")
    found = None
    for i in range(PASSES):
        own = F.expr(f"filter(parts, t -> pmod(shiftright(t, 7), {PASSES}) = {i})")
        postings = named.select(*keys, own.alias("own")).join(classes.select("rid", *keys), keys).select("rid", F.explode("own").alias("t"))
        shared = postings.groupBy("t").agg(F.count("*").alias("c")).filter("c >= 2").select("t")
        some = materialize(postings.join(shared, "t").groupBy("rid", F.col("t").bitwiseAND(_CLASS_BITS).alias("class")).agg(F.count("*").alias("hits")))
        found = some if found is None else found.unionByName(some)
    hits = found.groupBy("rid", "class").agg(F.sum("hits").alias("hits"))
    needs = named.select(*keys, F.explode("needs").alias("need")).join(classes, keys).select("rid", "first_id", "s1", "s2", F.col("need").bitwiseAND(_CLASS_BITS).alias("class"), F.shiftright("need", 7).alias("need"))
    enough = "hits >= need"
    # The condition stands again over the written table, where Spark's join filter looks for one.
    held = needs.join(hits, ["rid", "class"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).filter(enough)
    chosen = held.groupBy("rid").agg(*(F.any_value(c).alias(c) for c in ("first_id", "s1", "s2")), F.max("hits").alias("hits"), F.min("need").alias("need"))
    return materialize(chosen).filter(enough)


def _whole_sets(base: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The whole sets of the classes that stay: (rid, n, tokens)."""

    def sets(batches):
        for batch in batches:
            for part in slices(batch, 3, 1 << 20):
                found = shingle_sets(part.column(3), k)
                one, two = set_hashes(found)
                # An id may stand on rows of other texts: keep the row of this class.
                same = np.flatnonzero((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy()))
                kept = [found[i].view(np.int64) for i in same]
                if kept:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same)), pa.array([len(s) for s in kept], pa.int64()), list_array(np.concatenate(kept), np.concatenate(([0], np.cumsum([len(s) for s in kept]))), pa.int64())], ["rid", "n", "tokens"])

    texts = chosen.join(base, chosen.first_id == base.id).select("rid", "s1", "s2", "text")
    with join_filters(base.sparkSession):
        return materialize(texts.mapInArrow(sets, "rid long, n long, tokens array<long>"))


def _prefixes(whole: DataFrame, num: int, den: int) -> DataFrame:
    """Step 2: (rid, n, u, l, pre): u shingles of no other class, l and the shared shingles of the l-match prefix."""
    each = whole.select("rid", F.explode("tokens").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("df")).filter("df >= 2")
    # Bounded by the document: its own shingles come back to it.
    held = each.join(common, "t").groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("df", "t"))).alias("held"))
    back = held.join(whole.groupBy("rid").agg(F.any_value("n").alias("n")), "rid").select("rid", "n", "held")

    def choose(batches):
        for batch in batches:
            rows = []
            held = batch.column(2)
            off = np.asarray(held.offsets) - held.offsets[0].as_py()
            flat = held.flatten()
            df, tok = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, (rid, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                mine, cost = tok[off[i] : off[i + 1]], df[off[i] : off[i + 1]] - 1
                alone = n - len(mine)
                spare = n - needed(n, num, den) - alone
                if spare < 0:
                    continue
                total = np.cumsum(cost)
                options = [x for x in (1, 2, 4, 8, 16, 32, 64) if x == 1 or (x <= 1 + n // 10 and spare + x <= len(mine))]
                best = min(options, key=lambda x: (total[min(spare + x, len(mine)) - 1] / x, x))
                rows.append((rid, n, alone, best, mine[: spare + best]))
            if rows:
                a, b, c, d, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int32()), list_array(np.concatenate(e), np.concatenate(([0], np.cumsum([len(x) for x in e]))), pa.int64())], ["rid", "n", "u", "l", "pre"])

    return materialize(back.mapInArrow(choose, "rid long, n long, u long, l int, pre array<long>"))


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) of the pairs whose whole sets are similar."""
    left = whole.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = whole.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    held = pairs.join(left, "a").join(right, "b").withColumn("i", both.cast("long"))
    return materialize(held.filter(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num).select("a", "b").distinct())


def _can(num: int, den: int, n1: str, u1: str, n2: str, u2: str) -> F.Column:
    """Whether two classes can still be similar, given their sizes and lone shingles."""
    most = F.least(F.col(n1) - F.col(u1), F.col(n2) - F.col(u2))
    return most * den >= (F.col(n1) + F.col(n2) - most) * num


def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: id, n, s1, s2), (classes: n, s1, s2, first_id, component_id)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parted, classes = _classes(base, k, num, den)
    rows = materialize(parted.select("id", "n", "s1", "s2"))
    chosen = _candidates(parted, classes)
    discard(parted)
    whole = _whole_sets(base, chosen, k)
    prefixes = _prefixes(whole, num, den)

    postings = prefixes.select("rid", "n", "u", "l", F.explode("pre").alias("t"))
    lists = postings.groupBy("t").agg(F.count("*").alias("c"), F.min(F.struct("u", "rid", "n")).alias("lead")).filter("c >= 2")
    star = postings.join(lists, "t").select("rid", "n", "u", F.col("lead.u").alias("lu"), F.col("lead.rid").alias("lrid"), F.col("lead.n").alias("ln")).filter((F.col("rid") != F.col("lrid")) & _can(num, den, "n", "u", "ln", "lu"))
    first = _verified(star.groupBy("rid").agg(F.min(F.struct("lu", "lrid")).alias("x")).select(F.col("rid").alias("a"), F.col("x.lrid").alias("b")), whole, num, den)
    merged = connected_components(first)

    placed = materialize(postings.join(lists.select("t"), "t").join(merged, F.col("rid") == F.col("node"), "left").select("t", "rid", "n", "u", "l", F.coalesce("component", "rid").alias("component")))
    largest = placed.groupBy("t", "component").agg(F.count("*").alias("c")).groupBy("t").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "component")).alias("x")).filter("kinds >= 2").select("t", F.col("x.component").alias("largest"))
    mixed = placed.join(largest, "t").join(prefixes.select("rid", "pre"), "rid")
    left = mixed.filter("component != largest").select("t", "largest", *(F.col(c).alias(f"{c}1") for c in ("rid", "n", "u", "l", "component", "pre")))
    right = mixed.select("t", *(F.col(c).alias(f"{c}2") for c in ("rid", "n", "u", "l", "component", "pre")))
    apart = (F.col("component1") != F.col("component2")) & ((F.col("component2") == F.col("largest")) | (F.col("rid1") < F.col("rid2")))
    # A pair comes once: where it meets on the first shingle that both prefixes hold.
    shared = F.array_intersect("pre1", "pre2")
    # Of the set whose prefix ends first, every shared shingle in the prefix lies in the other prefix too, so the
    # overlap is at most those and what lies behind one prefix.
    most = F.size(shared) + F.greatest(F.col("n1") - F.col("u1") - F.size("pre1"), F.col("n2") - F.col("u2") - F.size("pre2"))
    once = (shared[0] == left.t) & (F.size(shared) >= F.least("l1", "l2")) & (most * den >= (F.col("n1") + F.col("n2") - most) * num)
    close = left.join(right, (left.t == right.t) & apart & _can(num, den, "n1", "u1", "n2", "u2") & once)
    pairs = close.select(F.col("rid1").alias("a"), F.col("rid2").alias("b"))
    second = _verified(pairs, whole, num, den)

    final = connected_components(first.unionByName(second))
    known = classes.select("rid", "n", "s1", "s2", "first_id").join(final, F.col("rid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rid"))
    heads = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = materialize(known.join(heads, "component").select("n", "s1", "s2", "first_id", "component_id"))
    discard(whole)
    return rows, labelled


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (the least id reachable by links)."""
    rows, classes = similar_components(docs, k, num, den, id_col, text_col)
    named = rows.join(classes, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id; rows linked with nothing, with null ids or without words all stay."""
    from docquarry.llm.base import append_columns

    _, classes = similar_components(docs, k, num, den, id_col, text_col)
    keep = classes.filter("first_id = component_id").select(F.col("n").alias("__dq_n"), F.col("s1").alias("__dq_s1"), F.col("s2").alias("__dq_s2"), F.col("first_id").alias("__dq_id"))
    marked = append_columns(docs, text_col, CLASS_FIELDS, class_columns(k))
    names = ["__dq_n", "__dq_s1", "__dq_s2"]
    loose = (F.col("__dq_n") == 0) | F.col(id_col).isNull()
    held = marked.filter(~loose).withColumn("__dq_id", F.col(id_col).cast("long")).join(keep, [*names, "__dq_id"], "left_semi").dropDuplicates([*names, "__dq_id"])
    return held.drop(*names, "__dq_id").unionByName(marked.filter(loose).drop(*names))
