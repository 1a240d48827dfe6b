"""Follow-the-regularised-leader logistic regression on sparse rows, trained by iterative parameter mixing.

A bounded, documented sample of labelled rows is dealt to a fixed number of shards; each shard runs
FTRL-proximal over its rows in one task, and Spark averages the shards' weights by feature.
The model is a dense vector of 2**BITS floats: its size is fixed and does not follow the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes


class Ftrl:
    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.at(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, balance: float, seed: int) -> np.ndarray:
    """Weights of one shard. balance: 1 weighs both labels alike, 0 takes them as they come. Slot size - 1 is the bias."""
    model = Ftrl(size, alpha, beta, l1, l2)
    positive = sum(y for *_, y in rows)
    share = min(max(positive / max(len(rows), 1), 1e-3), 1 - 1e-3)
    weight = {1.0: (0.5 / share) ** balance, 0.0: (0.5 / (1 - share)) ** balance}
    order = np.random.Generator(np.random.PCG64(seed))
    bias = np.array([size - 1])
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            model.learn(np.concatenate([i, bias]), np.concatenate([x, [1.0]]), y, weight[y])
    return model.at(np.arange(size))


def train(sample: DataFrame, rows_of, size: int, shards: int, **kw) -> np.ndarray:
    """sample(doc_id, text, label) -> weights, averaged over the shards that have rows.

    rows_of(pyarrow batch of doc_id, text) yields (row number, feature ids, values).
    An empty sample, or one with a single label, gives the weights that those rows support (0 for none).
    """

    def one(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        labels = batch.column("label").to_numpy().astype(float)
        rows, at = [], 0
        for part in passes(batch.select(["doc_id", "text"]).to_batches()):  # bounded slices, as in scoring
            rows += [(i.astype(np.int32), x.astype(np.float32), labels[at + k]) for k, i, x in rows_of(part)]
            at += part.num_rows
        w = fit(rows, size, seed=int(batch.column("shard")[0].as_py()), **kw)
        at = np.flatnonzero(w)
        return pa.table({"feature": np.append(at, size).astype(np.int32), "w": np.append(w[at], 1.0)})  # the last row counts filled shards

    dealt = sample.select("doc_id", "text", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    weights = dealt.groupBy("shard").applyInArrow(one, "feature int, w double").groupBy("feature").agg(F.sum("w").alias("w"))
    found, out = weights.toArrow(), np.zeros(size + 1)  # at most `size` + 1 rows of two numbers
    out[found["feature"].to_numpy()] = found["w"].to_numpy()
    return out[:size] / max(out[size], 1.0)


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out, bound: int) -> DataFrame:
    """At most `bound` labelled rows outside the held-out fold, chosen by a hash of the id, with whole texts.

    The bound makes the broadcast side at most `bound` ids; texts are not shuffled by this join.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
