"""Mixing to target weights with soft membership.

A softmax classifier learned from the labelled table gives each document its posterior over domains. The
unknowns are one nonnegative rate per document: how often it is to be seen. A document with n tokens and
posterior p adds rate * n * p_k expected tokens to domain k, and the rates are fitted so that the domains'
totals match the targets, by projected gradient on the least squares distance. A step needs of the
documents only the K sums of rate * n * p_k, one small aggregate, and moves every rate by the same
K numbers: rate = max(0, rate - p . g). So the rates never leave the executors, and after t steps they are
a fixed expression of p and t vectors of K numbers. Gradients are taken in the metric in which rates weigh
as their tokens, and residuals as the inverse of the K by K Gram matrix of the rates above zero.

The classifier learns from a bounded sample (``LEARN_ROWS``). Null ids and labels are not learned from.
Null and empty texts have no tokens; their rate is fitted like others' and moves no total. Repeated rows
count each. Without labels all domains are equally likely. A domain that no text resembles cannot be
filled: the distance is then least, not zero. An empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import fresh, written
from docaudit.llm.features import SIZE, Extractor, chosen_labels, learning_rows

#: Domains of the labelled table, and the share of tokens each is to get.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.92, 0.05, 0.03)
LEARN_ROWS = 12_000
#: Passes over the sample; more for a small one, so that at least LEAST batches are seen.
EPOCHS, LEAST, BATCH, RATE, DECAY = 12, 500, 256, 1.0, 1e-6
STEPS, TOLERANCE = 60, 1e-5


def domain(quality: Column, toxic: Column) -> Column:
    """Toxic before poor before good; null if either label is."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], domains: int, size: int = SIZE, seed: int = 11) -> np.ndarray:
    """Weights (size + 1, domains) of a softmax, the last row the bias."""
    theta = np.zeros((size + 1, domains))
    if not rows:
        return theta
    y = np.array([r[0] for r in rows])
    theta[-1] = np.log(np.bincount(y, minlength=domains) + 1.0)
    rng, square = np.random.default_rng(seed), np.full_like(theta, 1e-6)
    for _ in range(max(EPOCHS, LEAST * BATCH // max(BATCH, len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at:at + BATCH]]
            places, x = np.concatenate([r[1] for r in batch]), np.concatenate([r[2] for r in batch]).astype(np.float64)
            cuts = np.cumsum([0] + [len(r[1]) for r in batch[:-1]])
            doc = np.repeat(np.arange(len(batch)), [len(r[1]) for r in batch])
            z = np.add.reduceat(theta[places] * x[:, None], cuts, axis=0) + theta[-1]
            error = _softmax(z)
            error[np.arange(len(batch)), y[order[at:at + BATCH]]] -= 1
            error /= len(batch)
            touched, back = np.unique(places, return_inverse=True)
            g = np.zeros((len(touched), domains))
            np.add.at(g, back, error[doc] * x[:, None])
            touched, g = np.append(touched, size), np.vstack((g, error.sum(axis=0)))
            g += DECAY * theta[touched]
            square[touched] += g * g
            theta[touched] -= RATE * g / np.sqrt(square[touched])
    return theta


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def memberships(docs: DataFrame, theta: np.ndarray, id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """(id, tokens, p): words of the text and its posterior over domains."""
    sent = docs.sparkSession.sparkContext.broadcast(theta)
    size = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor()
        for batch in batches:
            weights, tokens, p = sent.value, [], []
            for t, n in zip(batch.column(1), batch.column(2)):
                places, values, words = extract(t.as_py(), n.as_py())
                tokens.append(words)
                p.append(_softmax(values @ weights[places] + weights[-1]).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["id", "tokens", "p"])
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), size.alias("n_chars")).mapInArrow(
        run, f"id {kind}, tokens bigint, p array<double>")


def _rate(steps: Sequence[np.ndarray]) -> Column:
    """The rate after the steps, from one."""
    rate = F.lit(1.0)
    for g in steps:
        move = sum((F.col("p")[k] * float(x) for k, x in enumerate(g)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(members: DataFrame, targets: Sequence[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient, and the shares of all tokens the domains have after them.

    A step in the metric of the free rates that doesn't bring the shares nearer to the targets is taken
    back and tried at a quarter, then a sixteenth; then a plain gradient step follows, which never
    overshoots. Targets that can be met take a few steps, others end after ``steps`` near the least distance.
    """
    k = len(targets)
    weight = np.array(targets, np.float64) / sum(targets)
    total = members.agg(F.sum("tokens")).first()[0]
    if not total:
        return [], np.zeros(k)
    part = lambda i: F.col("tokens") * F.col("p")[i]
    free = F.when(F.col("rate") > 0, 1.0).otherwise(0.0)
    wanted = [F.sum(F.col("rate") * part(i)) for i in range(k)] + [
        F.sum(w * part(i) * F.col("p")[j]) for w in (free, F.lit(1.0)) for i in range(k) for j in range(k)]
    moves: list[np.ndarray] = []
    shares, best, scale = np.zeros(k), np.inf, 1.0
    for _ in range(steps):
        found = np.array(members.select("tokens", "p", _rate(moves).alias("rate")).agg(*wanted).first(), np.float64) / float(total)
        gap, free_gram, gram = found[:k] - weight, *found[k:].reshape(2, k, k)
        if gap @ gap < best * (1 - 1e-6):
            shares, best, scale = found[:k], float(gap @ gap), 1.0
            if np.abs(gap).max() < tolerance:
                return moves, shares
            direction = np.linalg.solve(free_gram + 1e-9 * np.eye(k), gap)
            moves.append(direction)
        else:
            scale /= 4
            if scale < 0.01:  # not even the plain step helps
                break
            moves[-1] = direction * scale if scale > 0.05 else (shares - weight) / np.linalg.eigvalsh(gram)[-1]
    return moves[:-1], shares


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
          rows: int = LEARN_ROWS) -> np.ndarray:
    chosen = chosen_labels(labels, domain(F.col("quality"), F.col("toxic")), id, rows, F.lit(True))
    return fit(learning_rows(docs, chosen, id, text, n_chars), len(DOMAINS))


def mix(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, id: str = "doc_id", text: str = "text",
        n_chars: str | None = "n_chars") -> DataFrame:
    """(id, tokens, p, rate, copies) per row; copies is a whole number with the rate as its mean, drawn by
    a hash of the id, so that it is the same in every run."""
    members = written(memberships(docs, learn(docs, labels, id, text, n_chars), id, text, n_chars), "memberships")
    moves, _ = fit_rates(members, targets)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    rated = members.select("id", "tokens", "p", _rate(moves).alias("rate"))
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with columns rate and copies more (names made unique); no row is dropped.

    Rows with a null id have no rate. Of rows that repeat an id each gets the mean of their rates.
    """
    key, rate, copies = fresh(docs, "__key"), fresh(docs, "rate"), fresh(docs, "copies")
    rates = mix(docs, labels, id=id, text=text, n_chars=n_chars).groupBy(F.col("id").alias(key)).agg(
        F.avg("rate").alias(rate), F.max("copies").alias(copies))
    return docs.withColumn(key, F.col(id)).join(rates, key, "left").select(*docs.columns, rate, copies)
