"""Op 1. Quality classifier: hashed word n-gram logistic regression, FTRL-trained, scored as sparse dot products.

Features of a text: its tokens (words in lower case, punctuation runs) and token pairs, with marker
tokens for shouted words and for a token that repeats one of the two before it; each hashed to one of
2**18 slots. A row is the vector of counts, damped by log(1 + tf) and scaled to length 1.

Defined results: null and empty texts have no features and get the bias alone as score; rows with
equal texts get equal scores; a row without an id has no label and is not held out; without labelled rows all scores are 0.5; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .common import U64, Tokens, counted, mix, passes, table, tune, utf8

BITS = 18
SIZE = (1 << BITS) + 1
#: Bound of the labelled sample that the model is fitted on.
MAX_TRAIN_ROWS = 6000
SHARDS = 2


def features(batch: pa.RecordBatch):
    """(row number, feature ids, values) for each row of (doc_id, text); and flat arrays by `flat`."""
    ids, doc, x = flat(batch)
    cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    for k in range(batch.num_rows):
        yield k, ids[cut[k] : cut[k + 1]], x[cut[k] : cut[k + 1]]


def flat(batch: pa.RecordBatch):
    t = Tokens(*utf8(batch.column(1), lower=False), punctuation=True)
    h, doc = t.hashes(), t.doc
    pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]] if t.n > 1 else h[:0]
    pair_doc = doc[:-1][doc[:-1] == doc[1:]] if t.n > 1 else doc[:0]
    again = np.zeros(t.n, bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    shout = t.shouting()
    marks = [np.full(int(shout.sum()), 0x1234567890ABCDEF, U64), np.full(int(again.sum()), 0x5DEECE66D1234567, U64)]
    every = np.concatenate([h, pair, *marks])
    of = np.concatenate([doc, pair_doc, doc[shout], doc[again]])
    slot, of, n = counted(mix(every) >> U64(64 - BITS) << U64(12), of)
    x = np.log1p(n)
    norm = np.sqrt(np.bincount(of, x * x, minlength=batch.num_rows)) if len(of) else np.zeros(batch.num_rows)
    return slot.astype(np.int64), of, x / norm[of]


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    sample = linear.labelled(docs, labels, label, held_out, max_rows)
    return linear.train(sample, features, SIZE, SHARDS, epochs=4, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, balance=0.5)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score: the logistic of a sparse dot product over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scored(batches):
        for batch in passes(batches):
            w = shared.value
            ids, doc, x = flat(batch)
            s = np.bincount(doc, w[ids] * x, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s + w[SIZE - 1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, docs.select("doc_id", F.lit(0.0).alias("score")).schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string")) % 3 == 1
    weights = fit(docs, labels, fold)
    return score(docs, weights).select("doc_id", F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
