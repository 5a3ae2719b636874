"""Layout, full text, embedding, ingestion and answers against small cases worked out by hand, and against SQL."""

import re

import duckdb
import numpy as np
import pytest

from docquarry.functions.healing import STOP_WORDS
from docquarry.operators.answers import answer_questions, health, ingest_files, list_documents
from docquarry.operators.embedding import HashingEmbedder, embed
from docquarry.operators.fulltext import postings, search_postings, stem_of
from docquarry.operators.layout import assign_columns, extract_pages, heading_spaces, markdown_table, reading_order, tighten, with_inserted, words_to_table
from docquarry.operators.retrieval import cover_density
from docquarry.plans import documents

SF = "/root/testdata/sf0.001"
BLOCKS = "doc_id long, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double, font_size double, is_bold boolean, block_type string, page_width double, page_height double"


def page(spark, rows, doc=1):
    """rows: (seq, x0, y0, x1, kind[, font size[, text]])."""
    return spark.createDataFrame([(doc, 0, r[0], r[6] if len(r) > 6 else f"b{r[0]}", float(r[1]), float(r[2]), float(r[3]), r[2] + 12.0, float(r[5] if len(r) > 5 else 10), False, r[4], 600.0, 800.0) for r in rows], BLOCKS)


@pytest.mark.parametrize("name", sorted(documents.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = documents.QUERIES[name](spark, SF).toPandas(), con.execute(documents.SQL[name]).df()
    rows = lambda x: sorted(map(str, x[sorted(got.columns)].itertuples(index=False, name=None)))
    assert len(got) and rows(got) == rows(want)


def test_columns_and_order(spark):
    rows = [(0, 50, 60, 250, "text"), (1, 50, 300, 250, "text"), (2, 320, 60, 520, "text"), (3, 320, 300, 520, "text"), (4, 50, 200, 520, "text", 20), (5, 320, 200, 520, "text"), (6, 50, 0, 250, "text")]
    got = {r.seq: r for r in assign_columns(page(spark, rows)).collect()}
    assert [got[i].col for i in range(7)] == [0, 0, 1, 1, None, 1, 0] and {r.layout for r in got.values()} == {"two_columns"}
    # Block 5 is level with the full-width one, which is the last: it comes below; block 6 begins at 0 above it, and goes.
    order = [r.seq for r in reading_order(assign_columns(page(spark, rows))).orderBy("position").collect()]
    assert order == [0, 2, 4, 1, 5, 3]
    one = page(spark, rows[:2])
    assert [r.layout for r in assign_columns(one).collect()] == ["single"] * 2 and assign_columns(one.limit(0)).count() == 0
    table = page(spark, [*rows, (7, 50, 100, 250, "table")])
    mixed = with_inserted(reading_order(assign_columns(table)).select(*table.columns, "position"), table)
    assert [r.seq for r in mixed.orderBy("position").collect()] == [0, 2, 7, 4, 5, 1, 3]


def test_pages_render(spark):
    rows = [(0, 50, 60, 500, "text", 20, "Title"), (1, 50, 100, 500, "text", 10, "Body."), (5, 50, 120, 500, "text", 10, "More."), (2, 50, 140, 500, "text", 10, "Fig. 2 shows"), (3, 50, 780, 500, "text", 10, "footer"), (4, 50, 160, 500, "text", 10, "HAL Id: x")]
    both = page(spark, rows).unionByName(page(spark, [(0, 50, 5, 500, "text")], 2))
    got = {r.doc_id: r for r in extract_pages(both).collect()}
    assert got[1].text == "# Title\n\nBody.\n\nMore.\n\n[Figure: Fig. 2 shows]" and got[1].layout == "single"
    assert (got[2].layout, got[2].text, got[2].n_blocks) == ("empty", "", 0)


def test_word_tables():
    words = [(50 + 100 * c, 100 + 30 * r, 80 + 100 * c, 110 + 30 * r, f"{r}{c}") for r in range(3) for c in range(3)]
    assert words_to_table(words, (50, 95, 300, 180)) == [["00", "01", "02"], ["10", "11", "12"], ["20", "21", "22"]]
    more = words + [(150, 190, 180, 200, "on")]
    assert words_to_table(more, (50, 95, 300, 200))[-1] == ["20", "21 on", "22"]
    assert words_to_table(words[:3], (50, 95, 300, 180)) is None and words_to_table(words[::3], (50, 95, 300, 180)) is None
    assert markdown_table([["a|b", None], ["x\ny"]]) == "| a\\|b |  |\n| --- | --- |\n| x y |  |"


def test_boxes_and_headings(spark):
    blocks = page(spark, [(0, 50, 60, 250, "text"), (1, 50, 90, 250, "text")])
    words = spark.createDataFrame([(1, 0, 1, 60.0, 91.0, 70.0, 99.0), (1, 0, 1, 80.0, 92.0, 90.0, 98.0)], "doc_id long, page int, block_no long, x0 double, y0 double, x1 double, y1 double")
    got = {r.seq: (r.x0, r.y0, r.x1, r.y1) for r in tighten(blocks, words).collect()}
    assert got == {0: (50, 60, 250, 72), 1: (60, 91, 90, 99)}
    glyphs = spark.createDataFrame([(1, 0, 0, n // 4, n, c, float(x), x + 5.0, 10.0) for n, (c, x) in enumerate(zip("abcdefgh", (0, 5, 12, 17, 0, 5.5, 10.5, 20)))], "doc_id long, page int, block_no int, line int, n int, c string, x0 double, x1 double, font_size double")
    assert heading_spaces(glyphs).first().text == "ab cd\nefg h"


def test_embedding(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(["a b", "b a", "", None, "c " * 50000])], "id long, text string, embedding string")
    rows = {r.id: r.embedding for r in embed(df).collect()}
    assert rows[0] == rows[1] and rows[3] is None and not any(rows[2]) and np.isclose(np.linalg.norm(rows[4]), 1)
    assert embed(df.limit(0)).count() == 0

    class Wrong(HashingEmbedder):
        def embed(self, texts):
            return [[1.0] for _ in texts]

    with pytest.raises(Exception, match="length 64"):
        embed(df, Wrong).collect()


def test_full_text(spark):
    rng = np.random.default_rng(1)
    vocabulary = "orbits orbit satellite satellites the of boxes flies flying planned dish".split()
    texts = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 30))))) for i in range(80)] + [(90, None), (91, "")]
    index = postings(spark.createDataFrame(texts, "doc_id long, text string"))

    def brute(text):
        at = {}
        for p, w in enumerate(re.findall("[a-z]+", text or ""), 1):
            if w not in STOP_WORDS:
                at.setdefault(stem_of(w), []).append(p)
        phrase = [p for p in at.get("orbit", []) if p + 1 in at.get("satellite", [])]
        one = cover_density([phrase, at.get("dish", [])]) if phrase and at.get("dish") and not at.get("box") else None
        two = cover_density([at["fly"]]) if at.get("fly") else None
        return None if one is None and two is None else (one or 0) + (two or 0)

    want = sorted(((round(s, 9), -i) for i, t in texts if (s := brute(t)) is not None), reverse=True)[:20]
    got = search_postings(index, '"orbits satellite" dish -boxes or flies')
    assert [(round(r.score, 9), -r.doc_id) for r in got.collect()] == want
    assert search_postings(index, "the -orbit").count() == 0


def test_ingestion_goes_on_after_errors(spark):
    files = spark.createDataFrame([("d/a.pdf", bytearray(b"one")), ("d/b.pdf", bytearray(b"one")), ("d/c.pdf", bytearray(b"\xff")), ("d/e.pdf", bytearray(b""))], "path string, content binary")
    none = spark.createDataFrame([], "checksum string")
    got = {r.path: r for r in ingest_files(files, none, lambda raw: raw.decode()).collect()}
    assert [got[f"d/{x}.pdf"].status for x in "abce"] == ["ingested", "skipped", "failed", "ingested"] and got["d/c.pdf"].error.startswith("c.pdf: ")
    known = spark.createDataFrame([(got["d/a.pdf"].checksum,)], "checksum string")
    assert {r.path: r.status for r in ingest_files(files, known, lambda raw: raw.decode()).collect()}["d/a.pdf"] == "skipped"


def test_answers(spark):
    chunks = spark.createDataFrame([(1, "Orbits", "A > B", "Orbits are ellipses. More."), (2, None, None, "Dishes receive signals."), (3, "Empty", "", None)], "doc_id long, title string, section string, text string")
    asked = spark.createDataFrame([(10, "orbits are ellipses"), (11, "the orbital  period of x"), (12, None)], "query_id long, question string")
    got = {r.query_id: r for r in answer_questions(asked, embed(chunks), k=1).collect()}
    assert got[10].answer == "Orbits are ellipses. [1]\n\n## Sources\n- [1] Orbits — A > B" and got[10].citations[0].doc_id == 1
    assert got[11].query_type == "structured" and got[10].query_type == "retrieval" and got[12].n_blocks == 0 and len(got) == 3
    assert health(spark) == {"status": "healthy", "database": "ok", "embedder": "ok"}
    with pytest.raises(ValueError):
        list_documents(chunks, limit=501)
    assert [r.doc_id for r in list_documents(chunks, 2, 1).collect()] == [2, 1]
