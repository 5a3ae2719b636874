"""Hybrid retrieval: vector and keyword legs, fusion, reranking, diversity and context (inventory R, K, M, A)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.nearest import nearest


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_search(chunks: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """(vec_id, score) nearest first; ranks on id and vector only, so payload joins after the cut."""
    q = F.array(*map(F.lit, query))
    scored = chunks.filter(F.col("embedding").isNotNull()).select("vec_id", cosine(F.col("embedding"), q).alias("score"))
    best = scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "vec_id").limit(k)
    return best.select("vec_id", F.round("score", 6).alias("score"))


def semantic_batch(chunks: DataFrame, wanted, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest other rows of every row for which wanted holds.

    The stated query set meets all rows, in blocks; a shard of the rows keeps k a query before they are ranked.
    """
    kinds = dict(chunks.dtypes)
    e = chunks.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = chunks.filter(wanted).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    scored = nearest(e, q, k, True).select(F.col("query_id").cast(kinds["vec_id"]), F.col("id").cast(kinds["vec_id"]).alias("vec_id"), "score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long"))
    return ranked.filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (or) of terms that all hold: (wanted, words of a term or phrase)."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
        elif words := (phrase or word).split():
            out[-1].append((not minus, words))
    return [a for a in out if a]


def words_of(text) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \n\t\r]+"), lambda w: w != "")


def keyword_match(text, query: str) -> Column:
    """Whether the words of text satisfy a web-style query."""
    padded = F.concat(F.lit(" "), F.array_join(words_of(text), " "), F.lit(" "))
    held = F.lit(False)
    for terms in parse_websearch(query):
        here = F.lit(True)
        for wanted, words in terms:
            inside = padded.contains(" " + " ".join(words) + " ")
            here = here & (inside if wanted else ~inside)
        held = held | here
    return held


def keyword_rank(text, query: str) -> Column:
    """A tenth for each occurrence of a wanted word."""
    wanted = sorted({w for terms in parse_websearch(query) for yes, words in terms if yes for w in words})
    return F.round(F.size(F.filter(words_of(text), lambda w: w.isin(*wanted))) * F.lit(0.1), 6)


def cover_density(positions: list[list[int]], weight: float = 0.1) -> float:
    """Rank of the minimal covers of terms, given each term's positions: weights over harmonic means, less the words between."""
    if not positions or not all(positions):
        return 0.0
    if len(positions) == 1:
        return weight * len(positions[0])
    events = sorted((p, t) for t, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    total, begun = 0.0, -1
    for p, t in events:
        last[t] = p
        if len(last) == len(positions) and min(last.values()) > begun:
            begun = min(last.values())
            span = p - begun
            total += weight / (1 + max(0, span - (len(positions) - 1)))
    return total


def keyword_search(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    return docs.filter(keyword_match(F.col("text"), query)).select("doc_id", keyword_rank(F.col("text"), query).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def fuse(legs: list[DataFrame], k: int = 60, top: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of (id, score) legs: sum of 1 / (k + rank); ties by leg, then rank. Legs are top-k lists."""
    ranked = None
    for leg, df in enumerate(legs):
        key, score = df.columns
        one = df.select(F.col(key).alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"), F.lit(leg).alias("leg"))
        ranked = one if ranked is None else ranked.unionByName(one)
    first = F.min(F.struct("leg", "rank")).alias("first")
    fused = ranked.groupBy("chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), first)
    return fused.orderBy(F.desc("score"), "first").limit(top).select("chunk_id", "score", F.col("first.leg").alias("leg"), F.col("first.rank").cast("long").alias("leg_rank"))


def mmr(scores: np.ndarray, vectors: list, k: int = 5, balance: float = 0.7) -> list[int]:
    """Places in order of selection. Rows without vector go where any row has one; zero norms are unlike all."""
    have = [i for i, v in enumerate(vectors) if v is not None]
    if not have:
        return list(range(min(k, len(scores))))
    m = np.array([vectors[i] for i in have], np.float32)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    like = unit @ unit.T
    left, out = list(range(len(have))), []
    while left and len(out) < k:
        value = [balance * scores[have[i]] - (1 - balance) * (max(like[i, j] for j in out) if out else 0.0) for i in left]
        out.append(left.pop(int(np.argmax(value))))
    return [have[i] for i in out]


def diversify(candidates: DataFrame, k: int = 5, balance: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, position): a query's candidates are at most a few dozen rows."""

    def go(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        picks = mmr(g["score"].to_numpy(), g["embedding"].tolist(), k, balance)
        return pd.DataFrame({"query_id": g["query_id"].iloc[picks], "chunk_id": g["chunk_id"].iloc[picks], "position": range(1, len(picks) + 1)})

    return candidates.select("query_id", "chunk_id", "score", "embedding").groupBy("query_id").applyInPandas(go, "query_id long, chunk_id long, position long")
