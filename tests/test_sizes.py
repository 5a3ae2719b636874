"""Results and bounds of the steps that were rebuilt for larger tables."""

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def fold(a, b):
    out = 0.0
    for x, y in zip(a, b):
        out += float(x) * float(y)
    return out


def test_nearest_rows_are_the_folds_best_with_copies_nulls_and_lengths(spark):
    from pyspark.sql import functions as F

    from docquarry.operators.retrieval import semantic_batch

    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in np.float32(rng.normal(size=(300, 7)))]
    vectors[40:90] = [vectors[3]] * 50  # copies, whose ties go to the smaller id
    vectors[100:104] = [None, [0.0] * 7, [1.0, None] + [0.0] * 5, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(5)
    want = []
    for q in range(0, 300, 10):
        if q in range(100, 104):
            continue
        near = [(fold(v, vectors[q]) / (fold(v, v) ** 0.5 * fold(vectors[q], vectors[q]) ** 0.5), i) for i, v in enumerate(vectors) if i != q and i not in range(100, 104)]
        want += [(q, i, rank) for rank, (_, i) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:6], 1)]
    found = semantic_batch(df, F.col("vec_id") % 10 == 0, 6)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in found.collect()) == sorted(want)
    # Blocks of rows meet, no pair of rows is a row of the plan.
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_batch_searches_have_no_row_for_a_pair(spark):
    for name in ("mmr_select", "retrieval_metrics"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def made(spark, tmp_path, name, documents: pd.DataFrame):
    """(rows of a query, rows of its SQL) on documents alone."""
    documents.to_parquet(tmp_path / "documents.parquet", index=False)
    (tmp_path / "pages.parquet").symlink_to(f"{SF}/pages.parquet")  # read where its name stands in a query's text
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    found = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name]).df()[found.columns]
    return sorted(map(tuple, found.collect()), key=str), sorted((tuple(r) for r in want.astype(object).where(want.notna(), None).itertuples(index=False, name=None)), key=str)


def test_pages_of_a_half_go_to_the_even_number(spark, tmp_path):
    got, want = made(spark, tmp_path, "document_rows", pd.DataFrame({"doc_id": range(8), "text": "x", "n_chars": [0, 1499, 1500, 4500, 7500, 10500, 4501, 3000]}))
    assert got == want


ODD = pd.DataFrame({"doc_id": [1, 2, 3, 4, 5, 5, None, None], "text": ["A b\tc  a", "", None, " ".join(f"w{i % 7} x{i}" for i in range(40)), "p q p", "q r s t", "lost word", "lost b"]}).astype({"doc_id": "Int64"})


def test_index_counts_documents_by_id(spark, tmp_path):
    got, want = made(spark, tmp_path, "inverted_index", ODD)
    assert got == want and dict((r[0], r[1]) for r in got)["q"] == 1
    # Partial counts go by word alone.
    plan = entry.queries()["inverted_index"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lexeme" not in plan and "hashpartitioning(word#" in plan.replace("_groupingexpression", "word") and "doc_id" not in "".join(line for line in plan.split("\n") if "hashpartitioning(word" in line)


def test_tail_of_documents_longer_and_shorter_than_it(spark, tmp_path):
    got, want = made(spark, tmp_path, "overlap_tail", ODD[:5])
    assert got == want and len(got) == 3
    plan = entry.queries()["overlap_tail"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan  # all words of a text do not go through the window


def test_groups_cross_batches_and_pieces_whole(spark):
    from docquarry.operators.batches import by_group

    rows = [(i % 3, i, "x" * (i % 5)) for i in range(3000)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "g long, o int, t string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = by_group(df, ["g"], "o", lambda held: [(held[0][0], len(held), "".join(str(r[1]) for r in held[:4]))], "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found), key=str) == [(0, 1000, "0369"), (1, 1000, "14710"), (2, 1000, "25811"), (None, 1, "1")]


def test_merges_run_in_one_arrow_pass(spark):
    for name in ("paragraph_merge", "cross_page_merge"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_texts_pass_in_pieces():
    import pyarrow as pa

    from docquarry.operators.batches import PIECE_CHARS, pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * (PIECE_CHARS // 2)] * 7 + [None, "y" * 3 * PIECE_CHARS])], ["k", "t"])
    cut = list(pieces(batch, 1))
    assert [k for p in cut for k in p.column(0).to_pylist()] == list(range(9)) and [p.num_rows for p in cut] == [2, 2, 2, 2, 1]


def test_postings_of_rows_that_share_an_id_and_of_odd_texts(spark, tmp_path):
    from docquarry.operators.fulltext import postings

    got, want = made(spark, tmp_path, "postings_digest", ODD[:6])
    assert got == want
    df = spark.createDataFrame([(1, "The cats, cat"), (1, "cat"), (None, "dog"), (3, None)], "doc_id long, text string")
    assert sorted((r.lexeme, r.doc_id, list(r.positions)) for r in postings(df).collect()) == [("cat", 1, [1, 2, 3]), ("dog", None, [1])]
    # A word's row is not shuffled for each text: what is grouped by lexeme and id are the rows of shared ids.
    assert "MapInArrow" in postings(df)._jdf.queryExecution().toString()


def test_answers_embed_each_text_once(spark):
    plan = entry.queries()["answer_run"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # A pass each for: embedding texts and questions, packing both, scoring, answering.
    assert plan.count("MapInArrow") <= 6 and "NestedLoop" not in plan


def test_pages_are_read_and_dealt_once(spark, tmp_path):
    for name in ("column_assign", "page_order", "page_inserts", "page_extraction"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    lines = ["\n".join(f"line {i} of {n}" for i in range(n)) for n in (1, 12, 47, 75)]
    odd = pd.DataFrame({"doc_id": [*range(6), None], "source": "s", "text": [*lines, "", None, "lost\nlines"]}).astype({"doc_id": "Int64"})
    got, want = made(spark, tmp_path, "page_extraction", odd)
    assert got == want and [r[2:4] for r in got if r[0] is None] == [("empty", 0)]
