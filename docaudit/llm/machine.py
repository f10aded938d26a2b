"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The pairwise part is computed in
linear time as half the sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2. Weights are fitted on
the driver from a bounded sample of labelled rows (``LEARN_ROWS``); every document is scored in tasks
that get the weights, an array of fixed size, as a broadcast.

Null texts and texts without words are scored from their structure alone. A null n_chars is a feature of
its own. Null ids and repeated rows are scored like any other. Without labels, or with labels of one
kind, every score is the smoothed share of label 1. An empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.features import SIZE, Extractor, chosen_labels, learning_rows

#: At most about so many labelled rows are learned from.
LEARN_ROWS = 20_000
FACTORS = 8
#: Passes over the sample; more for a small one, so that at least STEPS batches are seen.
EPOCHS = 6
STEPS = 500
BATCH = 256
RATE = 0.02
DECAY = 1e-4
THRESHOLD = 0.3


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.v[places] * values[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.w[places] @ values + 0.5 * (total @ total - (v * v).sum()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int = SIZE, seed: int = 7) -> Machine:
    """Adam on the logistic loss, mini-batches in an order fixed by the seed."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], np.float64)
    start = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    model = Machine(float(start), np.zeros(size), np.zeros((size, FACTORS)))
    if len(set(y.tolist())) < 2:
        return model
    model.v = rng.normal(0, 0.05, (size, FACTORS))
    theta = np.concatenate((model.w[:, None], model.v), axis=1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(max(EPOCHS, STEPS * BATCH // max(BATCH, len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at:at + BATCH]]
            places = np.concatenate([r[1] for r in batch])
            x = np.concatenate([r[2] for r in batch]).astype(np.float64)
            cuts = np.cumsum([0] + [len(r[1]) for r in batch[:-1]])
            doc = np.repeat(np.arange(len(batch)), [len(r[1]) for r in batch])
            t = theta[places]
            vx = t[:, 1:] * x[:, None]
            total = np.add.reduceat(vx, cuts, axis=0)
            score = model.bias + np.add.reduceat(t[:, 0] * x, cuts) + 0.5 * (
                (total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), cuts))
            error = (sigmoid(score) - y[order[at:at + BATCH]]) / len(batch)
            model.bias -= 0.5 * error.sum()
            e = (error[doc] * x)[:, None]
            grad = np.concatenate((e, e * (total[doc] - vx)), axis=1)
            touched, back = np.unique(places, return_inverse=True)
            g = np.zeros((len(touched), FACTORS + 1))
            np.add.at(g, back, grad)
            g += DECAY * theta[touched]
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * g
            second[touched] = 0.99 * second[touched] + 0.01 * g * g
            theta[touched] -= RATE * (first[touched] / (1 - 0.9 ** step)) / (np.sqrt(second[touched] / (1 - 0.99 ** step)) + 1e-8)
    model.w, model.v = theta[:, 0].copy(), theta[:, 1:].copy()
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text",
          n_chars: str | None = "n_chars", learn: F.Column | None = None, rows: int = LEARN_ROWS) -> Machine:
    """Fit on documents with a label; ``learn`` says of the column ``id`` which may be learned from."""
    chosen = chosen_labels(labels, F.col(label).cast("int"), id, rows, F.lit(True) if learn is None else learn)
    return fit(learning_rows(docs, chosen, id, text, n_chars))


def score(docs: DataFrame, model: Machine, id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """(id, score) per row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))  # arrays: executors need no copy of this package
    size = F.col(n_chars).cast("long") if n_chars else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract, machine = Extractor(), Machine(*sent.value)
        for batch in batches:
            scores = [float(sigmoid(machine.margin(*extract(t.as_py(), n.as_py())[:2]))) for t, n in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text"), size.alias("n_chars")).mapInArrow(run, f"id {kind}, score double")
