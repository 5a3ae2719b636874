"""Operator 1, mixing sources to target weights: soft membership and document rates.

A softmax regression, trained on a bounded hash sample of the labelled table (max_labelled), gives each
document a posterior over domains from its byte histogram and hashed words; where ids repeat in the documents, at
most four times the bound are read. Projected-gradient least squares
then finds document rates r >= min_rate that bring the expected domain token totals sum(r * tokens * p) to
target weight * total. Each gradient step is one distributed pass over (tokens, posterior): executors send
K sums, the driver K numbers; a document's rate is a fold of its posterior over the short history of
residuals, so no state but that history is kept. Rates become whole copies by a hash of the row's id
and text: floor(r) copies, and one more with the chance of r's fraction.

Null and empty texts have no tokens and a posterior like any; repeated rows get one rate. Unreachable targets
end at the least-squares optimum. An empty table, or one without labelled rows, gives rate 1. Columns of docs
pass through; mix_* columns replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.base import append_columns, bounded_sample, bytes_of, list_array, materialize
from docquarry.llm.wordhash import words

_WORDS = 512


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each row, its features: shares of bytes and of hashed words, square roots)."""
    data, off = bytes_of(texts)
    rows = len(off) - 1
    h, at = words(texts)
    out = np.zeros((rows, 256 + _WORDS + 1))
    for i in range(rows):
        out[i, :256] = np.bincount(data[off[i] : off[i + 1]], minlength=256)
        out[i, 256:-1] = np.bincount((h[at[i] : at[i + 1]] & np.uint64(_WORDS - 1)).astype(np.int64), minlength=_WORDS)
    out[:, :256] /= np.maximum(out[:, :256].sum(1, keepdims=True), 1)
    out[:, 256:-1] /= np.maximum(out[:, 256:-1].sum(1, keepdims=True), 1)
    np.sqrt(out, out=out)
    out[:, -1] = 1
    return np.diff(at).astype(np.int64), out


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Accelerated gradient descent on the cross entropy."""
    w = np.zeros((x.shape[1], classes))
    v, t = w.copy(), 1.0
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge)
    want = np.eye(classes)[y]
    for _ in range(rounds):
        new = v - step * (x.T @ (softmax(x @ v) - want) / len(x) + ridge * v)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fold_rates(p: np.ndarray, history: list[np.ndarray], min_rate: float, momentum: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) of posteriors p after the steps in history."""
    r = np.full(len(p), max(1.0, min_rate))
    y, t = r, 1.0
    for g in history:
        new = np.maximum(min_rate, y - p @ g)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + ((t - 1) / t_new) * (new - r) if momentum else new
        r, t = new, t_new
    return r, y


def solve_rates(seen: DataFrame, weights: np.ndarray, min_rate: float, max_total: float | None, rounds: int, tolerance: float) -> tuple[list[np.ndarray], dict]:
    """The history of steps. seen: tokens long, posterior array<double>."""
    k = len(weights)

    def sums(history, squares):
        def run(batches):
            total = np.zeros(k * k if squares else 2 * k)
            for batch in batches:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
                if squares:
                    total += ((p * n[:, None]).T @ p).ravel()
                else:
                    for i, r in enumerate(fold_rates(p, history, min_rate)):
                        total[i * k : i * k + k] += (r * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = seen.select("tokens", "posterior").mapInArrow(run, "s array<double>")
        size = k * k if squares else 2 * k
        row = parts.agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size))).first()
        return np.array([x or 0.0 for x in row])

    gram = sums([], True).reshape(k, k)
    most = float(np.linalg.eigvalsh(gram)[-1]) if gram.any() else 0.0
    if most <= 0:
        return [], {"totals": np.zeros(k), "targets": np.zeros(k)}
    now = sums([], False)[:k]
    # With a floor of 1 no domain can shrink: the total grows until every target is reachable, up to max_total.
    scale = now.sum() if min_rate < 1 else float((now / np.maximum(weights, 1e-9)).max())
    if max_total is not None:
        scale = min(scale, max_total * now.sum())
    targets = weights * scale
    history: list[np.ndarray] = []
    for _ in range(rounds):
        got = sums(history, False)
        totals, ahead = got[:k], got[k:]
        if np.abs(totals - targets).sum() <= tolerance * scale:
            break
        history.append((ahead - targets) / most)
    return history, {"totals": totals, "targets": targets}


def mix(docs: DataFrame, labelled: DataFrame, domains: list[str], weights: list[float], id_col: str = "doc_id", text_col: str = "text", min_rate: float = 0.0, max_total: float | None = None, max_labelled: int = 6_000, rounds: int = 40, tolerance: float = 0.002) -> DataFrame:
    """docs with mix_tokens, mix_posterior, mix_rate and mix_copies. labelled: id_col and domain (a place in domains)."""
    k = len(domains)
    w = np.array(weights, float) / sum(weights)
    truth = labelled.filter(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__dq_id")).agg(F.max("domain").cast("int").alias("domain"))
    # An equal share of the bound for each domain; of bounded size: safe to broadcast.
    parts = [bounded_sample(truth.filter(F.col("domain") == d), ["__dq_id"], max_labelled // k) for d in range(k)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    read = docs.select(F.col(id_col).cast("long").alias("__dq_id"), F.col(text_col).alias("text"))
    sample = append_columns(read.join(F.broadcast(chosen), "__dq_id"), "text", "x binary", lambda t: [pa.array([r.astype("<f4").tobytes() for r in features(t)[1]], pa.binary())])
    # Ids may repeat in docs: of more than four times the bound, those of the least hashes fit the model.
    rows = sample.orderBy(F.xxhash64("__dq_id"), "x").limit(4 * max_labelled).select("domain", "x").collect()
    if rows:
        y = np.array([r.domain for r in rows])
        model = fit_softmax(np.array([np.frombuffer(r.x, "<f4") for r in rows], float), y, k)
        # The sample holds the domains in other shares than the labelled table; the last feature is constant.
        whole = {r.domain: r["count"] for r in truth.groupBy("domain").count().collect()}
        model[-1] += [np.log((whole.get(d, 0) + 0.5) / ((y == d).sum() + 0.5)) for d in range(k)]
    else:
        model = np.zeros((256 + _WORDS + 1, k))

    def posteriors(texts):
        tokens, x = features(texts)
        return tokens, softmax(x @ model)

    def measure(texts):
        tokens, p = posteriors(texts)
        return [pa.array(tokens), list_array(p.ravel(), np.arange(len(p) + 1) * k, pa.float64())]

    seen = materialize(append_columns(read, "text", "tokens long, posterior array<double>", measure).select("tokens", "posterior"))
    history, _ = solve_rates(seen, w, min_rate, max_total, rounds, tolerance) if rows else ([], {})

    def rate(texts):
        tokens, p = posteriors(texts)
        return [pa.array(tokens), list_array(p.ravel(), np.arange(len(p) + 1) * k, pa.float64()), pa.array(fold_rates(p, history, min_rate)[0])]

    out = append_columns(docs, text_col, "mix_tokens long, mix_posterior array<double>, mix_rate double", rate)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    floor = F.floor("mix_rate")
    return out.withColumn("mix_copies", (floor + (chance < F.col("mix_rate") - floor).cast("long")).cast("long"))
