"""Operator 6, toxicity: weak supervision from lexicon and pattern voters.

Voters look at whole texts only. Fixed voters hold an English lexicon. Mined voters hold words and word
beginnings of 4, 5 and 6 bytes that go with labels.toxic in a bounded sample of labelled rows of the training
folds (about max_labelled rows, the documented bound). Every voter votes toxic or not on every document; the counts of
the vote patterns over all documents fit a two-class generative label model by expectation maximisation,
which estimates each voter's accuracies, then from its posterior the voters' correlations within a class; a
voter's evidence is shared out among those that it is correlated with. A logistic regression on the voters'
match counts is trained on the model's posterior labels of a bounded hash sample (max_fit) and scores all.

Rows with crc32(id as text) mod 4 = 2 are held out: their labels are never read, and the classifier is not fitted on
them; their texts count, unlabelled, among the label model's vote patterns. A lexicon holds at most 400 words a kind (most).
Null and empty texts match nothing and get the score of that; repeated rows score alike; a table without
labelled toxic rows leaves only the fixed voters; an empty table gives an empty table. Null ids are never
held out. Columns of docs pass through; toxicity_score and toxicity replace columns of those names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import append_columns, bounded_sample, materialize, slices
from docquarry.llm.wordhash import NOT_WORD, word_prefixes

#: Common English insults.
INSULTS = "idiot moron stupid scum trash clown loser pathetic worthless disgusting imbecile jerk dumb retard filth vermin".split()
#: Bytes of a word's beginning; 0: the whole word.
KINDS = (0, 4, 5, 6)
GROUPS = 2  # voters of each kind


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hashes_of(lexicon: list[str]) -> np.ndarray:
    return np.unique(word_prefixes(pa.array([" ".join(lexicon)]), NOT_WORD, (0,))[0][0])


def _mine(labelled: DataFrame, least: int, precision: float, most: int) -> list[list[np.ndarray]]:
    """For each kind, its groups of hashes."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                found, off = word_prefixes(part.column(0), NOT_WORD, KINDS)
                row = np.repeat(np.arange(len(toxic)), np.diff(off))
                for kind, h in zip(KINDS, found):
                    pairs = np.unique(np.stack((h, row.astype(np.uint64))), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                    bad = toxic[pairs[1].astype(np.int64)]
                    keys, back = np.unique(pairs[0], return_inverse=True)
                    pos, neg = np.bincount(back[bad], minlength=len(keys)), np.bincount(back[~bad], minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["kind", "h", "pos", "neg"])

    table = labelled.select("text", "toxic").mapInArrow(count, "kind int, h long, pos long, neg long").groupBy("kind", "h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    good = materialize(table.filter((F.col("pos") >= least) & (F.col("pos") >= precision * (F.col("pos") + F.col("neg")))))
    out = []
    for kind in KINDS:
        rows = good.filter(F.col("kind") == kind).orderBy(F.desc("pos"), "h").limit(most).collect()
        keys = np.array([r.h for r in rows], np.int64).view(np.uint64)
        out.append([np.sort(keys[i::GROUPS]) for i in range(GROUPS)])
    return out


def _matches(texts: pa.Array, fixed: np.ndarray, mined: list[list[np.ndarray]]) -> np.ndarray:
    """Match counts of each row and voter, and the row's words in the last column."""
    found, off = word_prefixes(texts, NOT_WORD, KINDS)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(off))
    columns = []
    for h, lexicon in [(found[0], fixed), *((h, lex) for h, groups in zip(found, mined) for lex in groups)]:
        if not len(lexicon) or not len(h):
            columns.append(np.zeros(rows))
            continue
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        columns.append(np.bincount(row[lexicon[at] == h], minlength=rows).astype(float))
    return np.column_stack([*columns, np.diff(off)])


class LabelModel:
    """Latent-class model of binary votes with pairwise correlations."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60):
        """votes: distinct patterns (0/1); counts: rows of each."""
        total = counts.sum()
        start = (votes.sum(1) >= 1).astype(float)
        q = 0.98 * start + 0.01
        self.prior = prior
        for _ in range(rounds):
            self.hit = (q * counts) @ votes + 1.0
            self.hit /= (q * counts).sum() + 2.0
            self.false = ((1 - q) * counts) @ votes + 0.01
            self.false /= ((1 - q) * counts).sum() + 2.0
            self.hit, self.false = np.clip(self.hit, 1e-4, 1 - 1e-4), np.clip(self.false, 1e-6, 0.5)
            self.weight = np.ones(votes.shape[1])
            q = self.posterior(votes)
        self.correlation = np.zeros((2, votes.shape[1], votes.shape[1]))
        for c, w in enumerate(((1 - q) * counts, q * counts)):
            mean = w @ votes / max(w.sum(), 1e-9)
            d = votes - mean
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            self.correlation[c] = np.where(np.outer(sd, sd) > 1e-9, cov / np.outer(sd, sd), 0)
        shared = np.clip(self.correlation[1], 0, 1)
        np.fill_diagonal(shared, 1)
        self.weight = 1 / shared.sum(1)
        self.rows = total

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + (votes * np.log(self.hit / self.false) + (1 - votes) * np.log((1 - self.hit) / (1 - self.false))) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _inputs(m: np.ndarray) -> np.ndarray:
    """Of the classifier: any match, number and share of matches, for each voter."""
    hits, words = m[:, :-1], np.maximum(m[:, -1:], 1)
    return np.column_stack(((hits > 0).astype(float), np.log1p(hits), np.sqrt(hits / words), np.ones(len(m))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Newton's method on soft labels, both classes of equal weight in all."""
    w = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) / len(y) + ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, max_fit: int = 20_000, chance: float = 1e-4, precision: float = 0.97, most: int = 400, threshold: float = 0.3) -> DataFrame:
    """docs with toxicity_score (0 to 1) and toxicity (1: score >= threshold)."""
    key = F.col(id_col)
    truth = labels.filter(F.col("toxic").isNotNull() & key.isNotNull() & ~held_out(key)).groupBy(key.cast("long").alias("__dq_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(truth, ["__dq_id"], max_labelled)  # of bounded size: safe to broadcast
    read = docs.select(key.cast("long").alias("__dq_id"), F.col(text_col).alias("text"))
    labelled = read.join(F.broadcast(chosen), "__dq_id")
    share = chosen.agg(F.avg("toxic").alias("p")).first().p
    prior = min(max(float(share if share is not None else 0.05), 0.005), 0.5)
    # So often in toxic rows alone that chance would not do it.
    mined = _mine(labelled, max(3, math.ceil(math.log(chance) / math.log(prior))), precision, most)
    fixed = _hashes_of(INSULTS)
    voters = 1 + len(KINDS) * GROUPS

    seen = append_columns(read.withColumn("fit", ~held_out(F.col("__dq_id"))), "text", "m array<double>", lambda texts: [pa.array(list(_matches(texts, fixed, mined)), pa.list_(pa.float64()))])
    seen = materialize(seen.select("__dq_id", "fit", "m"))
    bits = F.expr(f"aggregate(transform(slice(m, 1, {voters}), (x, i) -> IF(x > 0, shiftleft(1, i), 0)), 0, (a, x) -> a + x)")
    patterns = seen.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()  # at most 2 ** voters rows
    if not patterns:
        beta = np.zeros(3 * voters + 1)
    else:
        codes = np.array([r.bits for r in patterns])
        votes = ((codes[:, None] >> np.arange(voters)) & 1).astype(float)
        model = LabelModel(votes, np.array([r.n for r in patterns], float), prior)
        # Voted-on rows are few, so the sample takes them first; the bound holds for both kinds together.
        some = F.exists(F.slice("m", 1, voters), lambda x: x > 0)
        parts = [bounded_sample(seen.filter("fit").filter(c), ["__dq_id"], max_fit // 2).select("m").collect() for c in (some, ~some)]
        m = np.array([r.m for p in parts for r in p]).reshape(-1, voters + 1)
        beta = _fit_logistic(_inputs(m), model.posterior((m[:, :-1] > 0).astype(float))) if len(m) else np.zeros(3 * voters + 1)

    def score(texts: pa.Array) -> list[pa.Array]:
        z = _inputs(_matches(texts, fixed, mined)) @ beta
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

    return append_columns(docs, text_col, "toxicity_score double", score).withColumn("toxicity", (F.col("toxicity_score") >= threshold).cast("int"))
