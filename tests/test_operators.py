import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docquarry.operators.chunking import blocks, chunk_markdown, sections, sentences
from docquarry.operators.pages import merge_pages, reflow
from docquarry.operators.retrieval import cover_density, fuse, keyword_match, mmr, parse_websearch
from pyspark.sql import functions as F


def test_sections_carry_paths():
    got = sections("intro\n# A\nx\n## B\ny\n# C\nz")
    assert got == [(None, "intro"), ("A", "x"), ("A > B", "y"), ("C", "z")]


def test_blocks_by_kind():
    assert [k for k, _ in blocks("p\np\n\n| a |\n| b |\n[Figure: 1]\nq")] == ["paragraph", "table", "figure", "paragraph"]


def test_sentences_keep_abbreviations():
    assert sentences("See Fig. A is. New one.") == ["See Fig. A is.", "New one."]


@given(st.lists(st.text("ab .#|\n", max_size=40), max_size=6), st.integers(1, 8))
def test_chunks_are_numbered_and_flagged(parts, most):
    got = chunk_markdown("\n".join(parts), most, 2)
    assert [c["chunk_index"] for c in got] == list(range(len(got)))
    assert all(c["is_oversized"] == (c["token_count"] > most) for c in got)


def test_oversized_table_stands_alone_and_breaks_overlap():
    got = chunk_markdown("# T\nbefore it\n\n| a b c d e f g |\n\nafter it", 5, 2)
    assert [c["has_table"] for c in got] == [False, True, False] and got[2]["content"] == "after it"


def test_reflow():
    assert reflow("a\nb-\nc\n\n- x\ny") == "a b-c\n\n- x y"


def test_merge_pages_moves_continuation():
    assert merge_pages(["The start of", "a sentence. Next one."]) == ["The start of a sentence.", "Next one."]


def test_websearch_grammar(spark):
    assert parse_websearch('a "b c" or -d') == [[(True, ["a"]), (True, ["b", "c"])], [(False, ["d"])]]
    df = spark.createDataFrame([("a b c",), ("a c b",), ("d",), ("e",)], "t string")
    assert [r[0] for r in df.select(keyword_match(F.col("t"), 'a "b c" or -d')).collect()] == [True, True, False, True]


def test_cover_density_prefers_near_terms():
    assert cover_density([[1], [2]]) > cover_density([[1], [9]]) > 0 == cover_density([[1], []])


def test_fusion_formula(spark):
    legs = [spark.createDataFrame(rows, "id long, score double") for rows in ([(1, 0.9), (2, 0.8)], [(2, 5.0)])]
    assert [(r.chunk_id, r.score) for r in fuse(legs).collect()] == [(2, pytest.approx(1 / 62 + 1 / 61)), (1, pytest.approx(1 / 61))]


def test_mmr_ties_nulls_and_diversity():
    v = [np.array([1.0, 0]), np.array([1.0, 0]), np.array([0, 1.0]), None]
    assert mmr([0.9, 0.9, 0.8, 1.0], v, 2) == [0, 2]
    assert mmr([0.9, 0.8], [None, None], 5) == [0, 1]
