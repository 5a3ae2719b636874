"""Full text: analyzer with stop words and light stems, postings with positions, cover-density ranking (inventory R4-R8)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.healing import STOP_WORDS
from docquarry.operators.batches import pieces, release
from docquarry.operators.retrieval import cover_density, parse_websearch


def stem(word) -> Column:
    """A light English stem: plural, -ing and -ed endings, of words that stay three letters long."""
    w = F.regexp_replace(word, "^(.+)ies$", "$1y")
    w = F.regexp_replace(w, "^(.+(?:s|x|z|ch|sh))es$", "$1")
    w = F.regexp_replace(w, "^(.{2,}[^s])s$", "$1")
    return F.regexp_replace(w, "^(.{3,}?)(?:ing|ed)$", "$1")


def stem_of(word: str) -> str:
    """stem() of one word of a query."""
    for pattern, to in ((r"^(.+)ies$", r"\1y"), (r"^(.+(?:s|x|z|ch|sh))es$", r"\1"), (r"^(.{2,}[^s])s$", r"\1"), (r"^(.{3,}?)(?:ing|ed)$", r"\1")):
        word = re.sub(pattern, to, word)
    return word


class _Lexemes(dict):
    """The lexeme of a word, none for a stop word; begun again when it is large."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = None if word in STOP_WORDS else stem_of(word)
        return found


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lexeme, doc_id, positions from 1, ascending) of texts: stop words go, but count as places. Null and empty texts have none.

    A text's postings are made where it is read; rows that share an id are merged afterwards, the only ones that are shuffled.
    """
    kind = dict(docs.dtypes)[id_col]
    split = re.compile("[^0-9a-z\xdf-\u024f]+")

    def run(batches):
        lexemes = _Lexemes()
        for batch in batches:
            for part in pieces(batch, 1):
                places, words, counts, flat = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    held: dict[str, list[int]] = {}
                    for at, word in enumerate(filter(None, split.split(text)), 1):
                        lexeme = lexemes[word]
                        if lexeme is not None:
                            if lexeme in held:
                                held[lexeme].append(at)
                            else:
                                held[lexeme] = [at]
                    places += [i] * len(held)
                    words += held
                    for p in held.values():
                        counts.append(len(p))
                        flat += p
                ends = pa.array(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), part.column(0).take(pa.array(places, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], ["lexeme", "doc_id", "positions"])
            release()

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    several = texts.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    schema = f"lexeme string, doc_id {kind}, positions array<int>"
    one = texts.join(several, same, "left_anti").mapInArrow(run, schema)
    more = texts.join(several, same, "left_semi").mapInArrow(run, schema)
    merged = more.groupBy("lexeme", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return one.unionByName(merged)


def search_postings(index: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(doc_id, score) of a web-style query over postings, best cover density first, ties to the smaller id.

    Only the query's lexemes are read of the index; one with none but stop words or unwanted terms finds nothing.
    """
    alternatives = [[(wanted, [(i, stem_of(w)) for i, w in enumerate(words) if w not in STOP_WORDS]) for wanted, words in terms] for terms in parse_websearch(query)]
    alternatives = [[(w, t) for w, t in terms if t] for terms in alternatives]
    lexemes = sorted({x for terms in alternatives for _, t in terms for _, x in t})
    if not lexemes:
        return index.select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def places(held: dict, term: list) -> list[int]:
        """Where the words of a term stand one after another."""
        sets = [{p - i for p in held.get(x, ())} for i, x in term]
        return sorted(set.intersection(*sets))

    @F.pandas_udf("double")
    def rank(lists: pd.Series) -> pd.Series:
        def one(pairs):
            held = {p["lexeme"]: list(p["positions"]) for p in pairs}
            best = None
            for terms in alternatives:
                at = [(wanted, places(held, t)) for wanted, t in terms]
                if at and all(bool(p) == wanted for wanted, p in at) and any(wanted for wanted, _ in at):
                    best = (best or 0.0) + cover_density([p for wanted, p in at if wanted])
            return best

        return lists.map(one)

    found = index.filter(F.col("lexeme").isin(*lexemes)).groupBy("doc_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("held"))
    return found.select("doc_id", rank("held").alias("score")).filter("score is not null").orderBy(F.desc("score"), "doc_id").limit(k)
