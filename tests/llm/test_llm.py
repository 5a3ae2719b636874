"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm.ann import ann_search, boxes, chi_square_cdf, kd_tree, walk
from docquarry.llm.components import connected_components
from docquarry.llm.jaccard import drop_near_duplicates, jaccard_join
from docquarry.llm.knn_join import knn_join
from docquarry.llm.mixing import fold_rates, mix
from docquarry.llm.packing import balance, pack
from docquarry.llm.passages import _along, align, chains, remove_passages, repeated_passages
from docquarry.llm.queries import QUERIES
from docquarry.llm.token_counts import token_counts
from docquarry.llm.token_store import Container, pack_container, token_output
from docquarry.llm.toolcalls import link_tool_calls
from docquarry.llm.toxicity import score_toxicity
from docquarry.llm.wordhash import shingle_sets

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, ""), (2, None), (3, "don't 'sam 're l'l ''s"), (4, "İstanbul ΣΑΣ ﬁ é 日本 １２ 🙂"), (5, "<|endoftext|>a <|startoftext|>"), (6, "word " * 9000), (6, "word " * 9000), (7, "a" * 3000), (8, "\x1c\x85 x\ty"), (None, "no id")]
WORDS = [f"w{i}" for i in range(4000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, n string, t int")


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark):
    got = token_counts(docs_of(spark, ODD), PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((t or "").encode()), len(library(t))) for _, t in ODD)
    assert token_counts(docs_of(spark, ODD).limit(0), PATH).count() == 0


def test_token_store_round_trip(spark):
    got = sorted(map(tuple, token_output(docs_of(spark, ODD), PATH, shard_tokens=5000).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*library(t), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want
    with pytest.raises(ValueError):
        Container(pack_container([b""], 4, b"\0" * 32), b"other")


def test_packing_covers_every_id(spark):
    got = pack(docs_of(spark, ODD), PATH, group_docs=4).toPandas()
    want = sum(len(library(t)) + 1 for _, t in ODD)
    pieces = collections.defaultdict(list)
    for r in got.itertuples():
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for i, t in ODD:  # equal rows have equal pieces
        ids = np.array([*library(t), 1], "<u4")
        mine = pieces[i if i is not None else next(k for k, _ in pieces if k != k), len(ids)]
        copies = sum((i, t) == x for x in ODD)
        assert all(zlib.crc32(ids[s : s + n]) == c for s, n, c in mine)
        assert collections.Counter(p for s, n, _ in mine for p in range(s, s + n)) == dict.fromkeys(range(len(ids)), copies)
    assert pack(docs_of(spark, ODD).limit(0), PATH).count() == 0
    assert got.length.sum() == want and (got.groupby("sequence_id").length.sum() <= 2048).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    sizes = np.random.default_rng(0).integers(1, 2048, 500)
    used = collections.Counter()
    for _, _, n, b, _ in balance(sizes, 2048):
        used[b] += n
    assert sum(used.values()) == sizes.sum() and sum(2048 - u for u in used.values()) < 2048


def test_exact_join_and_projected_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 8))
    m[50:250] = m[50]  # a third of the rows are one vector
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(m)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [None] * 8, "x"), (904, [1.0] * 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    q = df.filter("vec_id % 50 = 0")
    z = np.floor(256 * np.vstack((m, np.zeros((1, 8))))).astype(int)
    ids = np.array([*range(600), 901])
    want = {(int(a), r + 1, int(ids[j]), int(s[j])) for a in range(0, 600, 50) for s in [z @ z[a]] for r, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != a][:5])}
    assert {tuple(r) for r in knn_join(q, df, block_rows=64, n_pivots=8).collect()} == want
    # Many small blocks, of fewer rows than k + 1 too, with pivots that grow in number and whole cells tried first.
    for rows in (3, 16):
        assert {tuple(r) for r in knn_join(q, df, block_rows=rows, query_rows=5, n_pivots=2).collect()} == want
    got = ann_search(q, df, k=10, shard_rows=200).toPandas()
    hit = 0
    for a, g in got.groupby("query_id"):
        s = m @ m[a]
        best = [j for j in np.lexsort((np.arange(600), -s)) if j != a][:10]
        hit += len(set(best) & set(g.vec_id))
        assert np.allclose(g.score, s[g.vec_id])
    assert hit / len(got) >= 0.9 and len(got) == 120
    assert knn_join(q, df.limit(0)).count() == 0 and ann_search(q, df.limit(0)).count() == 0
    assert abs(chi_square_cdf(2.0, 2) - (1 - np.exp(-1))) < 1e-12


def test_tree_walk_is_in_order():
    p = np.random.default_rng(36).normal(size=(3000, 16))
    leaves, nodes = kd_tree(p, 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= 32
    low, high = boxes(p, leaves, nodes)
    q = np.full(16, 0.5)
    came = list(walk(q, nodes, low, high))
    want = sorted(float((np.maximum(np.maximum(p[x].min(0) - q, q - p[x].max(0)), 0) ** 2).sum()) for x in leaves)
    assert np.allclose([d for d, _ in came], want) and sorted(i for _, i in came) == list(range(len(leaves)))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    got = QUERIES["op5_ann"](spark, f"/root/testdata/sf{sf}").toPandas()
    rows = e.toPandas()
    ids, m = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    hit = 0
    for a, g in got.groupby("query_id"):
        s = m @ m[ids == a][0]
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != a][:20]
        hit += len(set(ids[best]) & set(g.vec_id))
    assert len(got) == 20 * (ids % 20 == 0).sum() and hit / len(got) >= 0.9
    print("recall", sf, hit / len(got))


def near_copies(rng, n=60):
    base = list(rng.choice(WORDS, 200))
    rows = [(i, " ".join(rng.choice(WORDS, 150))) for i in range(n)]
    for i in range(n, 2 * n):
        words = list(base)
        for at in rng.integers(0, 200, i % 9):
            words[at] = str(rng.choice(WORDS))
        rows.append((i, " ".join(words)))
    return rows + [(500, rows[0][1]), (501, "one two"), (502, "One  TWO"), (503, ""), (504, None), (None, rows[0][1]), (505, "the " * 30000)]


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, num):
    rows = near_copies(np.random.default_rng(2))
    sets = [frozenset(s.tolist()) for s in shingle_sets(pa.array([t for _, t in rows]), k)]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, s) for (i, _), s in zip(rows, sets) if i is not None]
    for a, sa in known:
        for b, sb in known:
            if a < b and sa and 100 * len(sa & sb) >= num * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs_of(spark, rows), k, num).collect()}
    assert got == {i: (len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)}
    kept = [r.doc_id for r in drop_near_duplicates(docs_of(spark, rows), k, num).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({find(i) for i, _ in known}) and kept.count(None) == 1
    assert jaccard_join(docs_of(spark, rows).limit(0), k, num).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (200, 100)}


def test_passages(spark):
    rng = np.random.default_rng(3)
    passage = list(rng.choice(WORDS, 70))
    fuzzy = [w if i % 17 else "edited" for i, w in enumerate(passage)]
    rows = [(i, " ".join(rng.choice(WORDS, 120))) for i in range(20)]
    for i, p in ((3, passage), (8, passage), (9, fuzzy), (12, passage[:30])):
        rows[i] = (i, rows[i][1] + " " + " ".join(p) + " tail")
    rows += [(30, None), (31, ""), (None, " ".join(passage))]
    df = docs_of(spark, rows)
    got = repeated_passages(df)
    assert {(r.doc_id, r.other_doc_id) for r in got.collect()} == {(8, 3), (9, 3)}
    assert {r.n_words for r in got.filter("doc_id = 8").collect()} == {71}
    after = {r.doc_id: r.text for r in remove_passages(df, got).collect()}
    assert after[3] == rows[3][1] and passage[10] + " " + passage[11] not in after[8] and after[5] == rows[5][1] and len(after) == len(rows)
    assert repeated_passages(df.limit(0)).count() == 0
    x = np.array([0, 10, 25, 400])
    assert [p.tolist() for p in chains(x, x + 3, np.full(4, 6), 0.1, 5, 100)] == [[0, 1, 2], [3]]
    assert align(np.array([1, 2, 3, 9, 4]), np.array([7, 1, 2, 3, 4]), [0, 1])[4] >= 3


def test_all_passages_of_a_chain(spark):
    rng = np.random.default_rng(30)
    own, other = [f"x{i}" for i in range(2000)], [f"y{i}" for i in range(2000)]

    def pair(blocks, gap):
        parts = [list(rng.choice(WORDS, n)) for n in blocks]
        return [" ".join(" ".join(p + [str(w) for w in rng.choice(filler, gap)]) for p in parts) for filler in (own, other)]

    texts = [*pair((100, 100), 60), *pair((60, 60, 60), 29)]
    got = repeated_passages(docs_of(spark, enumerate(texts, 1))).collect()
    want = {(2, 1, 0, 100), (2, 1, 160, 100), (4, 3, 0, 60), (4, 3, 89, 60), (4, 3, 178, 60)}
    assert {(r.doc_id, r.other_doc_id, r.start_word, r.n_words) for r in got} == want and all(r.matches == r.n_words for r in got)


def test_passages_whose_seeds_have_several_leaders(spark):
    rng = np.random.default_rng(31)
    rows = [(i, [f"u{i}_{j}" for j in range(60)]) for i in range(12)]
    passage = list(rng.choice(WORDS, 80))
    for i, p in ((1, passage[:40]), (2, passage[40:]), (5, passage), (9, passage)):
        rows[i] = (i, rows[i][1] + p + rows[i][1])
    # Of 200 shared words all but the first 60 have their seeds led by two other documents.
    long = list(rng.choice(WORDS, 200))
    for i, p in ((3, long[60:130]), (4, long[130:]), (6, long), (7, long)):
        rows[i] = (i, rows[i][1] + p + rows[i][1])
    got = repeated_passages(docs_of(spark, [(i, " ".join(p)) for i, p in rows]))
    found = {(r.doc_id, r.other_doc_id, r.start_word, r.n_words) for r in got.collect()}
    assert (9, 5, 60, 80) in found and (7, 6, 60, 200) in found


def test_repeats_within_a_document(spark):
    rng = np.random.default_rng(32)
    passage, line = list(rng.choice(WORDS, 80)), list(rng.choice(WORDS, 20))
    shared = {(1, 2): (passage, passage), (3, 4): (line * 15,), (5, 6): (["again"] * 300,)}
    rows, places = [], {}
    for (first, second), parts in shared.items():
        rows.append((first, [f"u{first}_{j}" for j in range(60)] + parts[0] + [f"v{first}_{j}" for j in range(60)]))
        words, places[second] = [], set()
        for n, p in enumerate(parts):
            words += [f"u{second}_{n}_{j}" for j in range(60)]
            places[second] |= set(range(len(words), len(words) + len(p)))
            words += p
        rows.append((second, words))
    cut = collections.defaultdict(set)
    for r in repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        cut[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    assert cut == places


def best_chain(x, y, size, gap):
    """The best chain's score by looking at all pairs of blocks."""
    score = {}
    for i in sorted(range(len(x)), key=lambda i: (x[i], y[i])):
        score[i] = size[i] + max([0.0, *(score[j] - gap * (x[i] - x[j] - size[j] + y[i] - y[j] - size[j]) for j in score if x[j] + size[j] <= x[i] and y[j] + size[j] <= y[i])])
    return max(score.values())


def test_chains_against_all_pairs():
    rng = np.random.default_rng(33)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        x, y, size = rng.integers(0, 120, n), rng.integers(0, 120, n), rng.integers(1, 12, n)
        top = chains(x, y, size, 0.1, 0.0, 10**6)[0]
        gained = size[top].sum() - 0.1 * (x[top[-1]] - x[top[0]] + y[top[-1]] - y[top[0]] - 2 * size[top[:-1]].sum())
        assert np.isclose(gained, best_chain(x.tolist(), y.tolist(), size.tolist(), 0.1))
        assert all(x[a] + size[a] <= x[b] and y[a] + size[a] <= y[b] for a, b in zip(top, top[1:]))


def test_alignment_by_zones_against_the_whole():
    rng = np.random.default_rng(35)
    for _ in range(200):
        b = rng.integers(0, int(rng.choice([2, 5, 50])), int(rng.integers(1, 200)))
        a = np.where(rng.random(len(b)) < 0.2, 0, b)[int(rng.integers(0, len(b))) :]
        diagonals = sorted({len(b) - len(a), *rng.integers(-20, 60, 3).tolist()})
        if len(diagonals) > 1:
            at = np.arange(len(a))[:, None] + np.array(diagonals)[None]
            equal = (at >= 0) & (at < len(b)) & (b[np.clip(at, 0, len(b) - 1)] == a[:, None])
            for cost in (-2, -4, -9):
                assert align(a, b, diagonals, cost) == _along(equal.tolist(), 0, diagonals, cost, -4)[1:]


def test_every_exact_passage_is_found(spark):
    """Texts built of few shared bits, against all windows: a run of 58 words that an earlier row holds is covered but for 4 at its ends."""
    rng = np.random.default_rng(34)
    bits = [[str(w) for w in rng.choice(WORDS, int(rng.integers(5, 45)))] for _ in range(12)]
    rows = [(int(i // 2), sum((bits[b] if b < 12 else [f"u{i}_{j}" for j in range(20)] for b in rng.integers(0, 14, int(rng.integers(2, 14)))), [])) for i in range(60)]
    got = collections.defaultdict(set)
    for r in repeated_passages(docs_of(spark, [(i, " ".join(w)) for i, w in rows]), min_identity=1.0).collect():
        got[r.doc_id, r.text_crc] |= set(range(r.start_word, r.start_word + r.n_words))
    crc = lambda w: zlib.crc32(" ".join(w).encode()) & 0x7FFFFFFF
    seen, checked = set(), 0
    for i, w in sorted(rows, key=lambda r: (r[0], crc(r[1]))):
        mine = [tuple(w[j : j + 58]) for j in range(len(w) - 57)]
        want = {p for j, m in enumerate(mine) if m in seen for p in range(j + 4, j + 54)}
        assert want <= got[i, crc(w)], (i, sorted(want - got[i, crc(w)])[:5])
        seen |= set(mine)
        checked += len(want)
    assert checked > 1000


def test_rows_that_share_an_id(spark):
    words = [f"p{j}" for j in range(100)]
    clean = " ".join(f"c{j}" for j in range(301))
    text = " ".join(words + [f"x{j}" for j in range(50)])
    rows = [(3, " ".join(words)), (40, text), (40, clean), (40, text), (41, "long " * 20000), (42, "long " * 20000)]
    df = docs_of(spark, rows)
    got = repeated_passages(df)
    assert {(r.doc_id, r.n_words) for r in got.collect() if r.doc_id == 40} == {(40, 100)}
    after = collections.Counter((r.doc_id, r.text) for r in remove_passages(df, got).collect())
    assert after[40, clean] == 1 and after[40, " ".join(f"x{j}" for j in range(50))] == 2 and after[3, " ".join(words)] == 1 and after[42, ""] == 1


def test_passages_with_edits(spark):
    """The share of 80-word passages found, with one word in ten and one in seven other, at random places."""
    rng = np.random.default_rng(35)
    rows, n = [], 100
    for share, at in ((0.1, 0), (1 / 7, 1000)):
        for i in range(n):
            passage = [str(w) for w in rng.choice(WORDS, 80)]
            for j, p in enumerate((passage, [f"e{i}_{j}" if rng.random() < share else w for j, w in enumerate(passage)])):
                rows.append((at + i + j * 500, " ".join([f"l{at}_{i}_{j}_{x}" for x in range(40)] + p + [f"r{at}_{i}_{j}_{x}" for x in range(40)])))
    found = {r.doc_id for r in repeated_passages(docs_of(spark, rows)).collect()}
    easy, hard = (sum(at + i + 500 in found for i in range(n)) for at in (0, 1000))
    assert easy >= 95 and hard >= 85 and not found & {i for i, _ in rows if i % 1000 < 500}


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["red", "green"] if i % 3 else ["blue!", "black!"], int(rng.integers(5, 60))))) for i in range(300)] + [(300, None), (301, ""), (None, "red")]
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(0, 300, 2)], "doc_id long, domain int")
    got = mix(docs_of(spark, rows), labels, ["a", "b"], [0.5, 0.5]).toPandas()
    totals = sum(r * n * np.array(p) for r, n, p in zip(got.mix_rate, got.mix_tokens, got.mix_posterior))
    assert np.allclose(totals / totals.sum(), 0.5, atol=0.02) and (got.mix_rate >= 0).all() and len(got) == 303
    floor = mix(docs_of(spark, rows), labels, ["a", "b"], [0.5, 0.5], min_rate=1.0).toPandas()
    assert (floor.mix_copies >= 1).all()
    p = np.array([[1.0, 0.0]])
    assert fold_rates(p, [np.array([0.25, 0.0])], 0.0)[0][0] == 0.75
    assert mix(docs_of(spark, rows).limit(0), labels, ["a", "b"], [1, 1]).count() == 0


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for i in range(600):
        words, bad = list(rng.choice(WORDS, 40)), i % 6 == 0
        if bad:
            words[3:6] = [f"zorgb{rng.integers(5)}"] * 2 + (["idiot,"] if i % 4 else ["zorgb9"])
        rows.append((i, " ".join(words)))
        truth.append((i, int(bad)))
    got = {r.doc_id: r for r in score_toxicity(docs_of(spark, [*rows, (900, None), (901, ""), (None, "x")]), spark.createDataFrame(truth, "doc_id long, toxic int")).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].toxicity == truth[i][1] for i in out) and len(got) == 603 and got[900].toxicity == got[901].toxicity == 0
    assert score_toxicity(docs_of(spark, rows).limit(0), spark.createDataFrame(truth, "doc_id long, toxic int")).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame([("a", "f", '{"y": 2, "x": 1}', None, 1), ("b", "f", '{"x": "1"}', "a", 2), ("c", "f", "no json", "b", 3), ("d", "g", "{}", "e", 4), ("e", "f", "{}", "d", 5), ("a", "f", "{}", None, 9), (None, "f", "{}", None, 1)], "id string, name string, arguments string, after string, position int")
    results = spark.createDataFrame([("a", "r", 1), ("z", "s", 2)], "id string, content string, position int")
    got = {r.id: r for r in link_tool_calls(calls, results, {"f": {"x": ("BIGINT|INT|TINYINT", True)}}).collect()}
    assert [(got[i].status, got[i].level, got[i].problem) for i in "abcde"] == [("linked", 0, None), ("unanswered", 1, "wrong type of x"), ("unanswered", 2, "arguments are no object"), ("unanswered", None, "unknown tool"), ("unanswered", None, "missing x")]
    assert got["z"].status == "orphan" and got["a"].n_calls == 2
    assert got["a"].message == '{"arguments":{"x":1,"y":2},"id":"a","level":0,"name":"f","result":"r"}' and json.loads(got["z"].message)["arguments"] is None


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    assert corpus_pipeline.run(spark, sf).count() > 0 and "op9_jaccard" in QUERIES and re.match("op", next(iter(QUERIES)))
