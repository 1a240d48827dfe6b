"""Op 10. Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: presence of each character n-gram of 3 to 6 code points of the lower-cased text, hashed to 2**20
slots. The value of a present feature is its log-count ratio r = log((p/|p|)/(q/|q|)) between the
document counts of toxic and clean training rows, smoothed by 1. Slots that fewer than MIN_DOCS training rows hold, or whose
|r| is under MIN_RATIO, are no features. FTRL logistic regression, labels weighing alike, is trained on these values.
Scoring multiplies weight and ratio once, so it is one gather and sum per text. Sizes, MIN_DOCS and MIN_RATIO were chosen
on an inner fold of the training rows.

Defined results: null and empty texts get the bias alone; equal texts get equal scores; without
labelled rows all scores are 0.5; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .common import POWERS, U64, mix, passes, table, tune

BITS = 20
SIZE = (1 << BITS) + 1
SIZES = (3, 4, 5, 6)
#: Bound of the labelled sample that ratios and weights are fitted on.
MAX_TRAIN_ROWS = 16000
SHARDS = 2
MIN_RATIO, MIN_DOCS = 2.0, 6


def letters(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first of each text and the end) of the lower-cased texts; null counts as empty."""
    texts = [(s or "").lower() for s in batch.column(1).to_pylist()]
    size = np.array([len(s) for s in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, np.cumsum(size))


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(slot, doc) of every character n-gram, repeats included."""
    chars, off = letters(batch)
    slots, docs = [], []
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    code, done = mix(chars.astype(U64) + U64(1)), 1
    h = code.copy()
    for size in SIZES:
        m = len(chars) - size + 1
        if m <= 0:
            continue
        h = h[:m]
        for k in range(done, size):
            h += code[k : k + m] * POWERS[k]
        done = size
        ok = doc[:m] == doc[size - 1 :]
        slots.append((mix(h[ok] + U64(size)) >> U64(64 - BITS)).astype(np.int32))
        docs.append(doc[:m][ok])
    return (np.concatenate(slots), np.concatenate(docs)) if slots else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def present(batch: pa.RecordBatch, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (slot, doc), ordered by doc; keep: a mask of slots."""
    slot, doc = grams(batch)
    if keep is not None:
        ok = keep[slot]
        slot, doc = slot[ok], doc[ok]
    key = np.sort((doc.astype(np.int64) << 32) | slot)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key & 0xFFFFFFFF).astype(np.int64), key >> 32


def ratios(sample: DataFrame) -> np.ndarray:
    """log-count ratio by slot, from document counts by label; each task sends at most 2**20 counts a label."""

    def count(batches):
        n = np.zeros((2, SIZE), np.int32)
        for batch in passes(batches):
            label = np.asarray(batch.column(2).to_numpy(zero_copy_only=False)).astype(int)
            slot, doc = present(batch)
            for k in (0, 1):
                at = np.sort(slot[label[doc] == k])
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                n[k, at[first]] += np.diff(np.append(first, len(at))).astype(np.int32)
        at = np.flatnonzero(n.sum(0) > 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at].astype(np.int64)), pa.array(n[1, at].astype(np.int64))], ["slot", "clean", "toxic"])

    counts = sample.select("doc_id", "text", "label").mapInArrow(count, "slot int, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    every = sample.agg(F.count_if(F.col("label") != 1).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).first()
    log = lambda c: F.log((F.col(c) + 1.0) / (every[c] + 2.0))
    told = counts.withColumn("r", log("toxic") - log("clean")).where((F.abs("r") >= MIN_RATIO) & (F.col("clean") + F.col("toxic") >= MIN_DOCS))
    found = told.select("slot", F.col("r").cast("float")).toArrow()  # two numbers a slot, 2**20 slots at most
    r = np.zeros(SIZE)
    r[found["slot"].to_numpy()] = found["r"].to_numpy()
    r[-1] = 1
    return r


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """The product of weights and ratios by slot; the last slot is the bias."""
    from .common import durable

    sample = durable(linear.labelled(docs, labels, label, held_out, max_rows))
    spark = docs.sparkSession
    r = ratios(sample)
    shared = spark.sparkContext.broadcast(r.astype(np.float32))

    def rows(batch):
        scale = shared.value
        slot, doc = present(batch, scale != 0)
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        for k in range(batch.num_rows):
            at = slot[cut[k] : cut[k + 1]]
            yield k, at, scale[at]

    w = linear.train(sample, rows, SIZE, SHARDS, epochs=4, alpha=0.1, beta=1.0, l1=0.1, l2=0.1, balance=1.0)
    return w * r


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def scored(batches):
        w = shared.value
        keep = w[:-1] != 0
        for batch in passes(batches):
            slot, doc = present(batch, keep)
            s = np.bincount(doc, w[slot], minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, docs.select("doc_id", F.lit(0.0).alias("score")).schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string")) % 5 == 0
    weights = fit(docs, labels, fold)
    return score(docs, weights).select("doc_id", F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """docs without those scored at or over the threshold; all columns kept, repeated rows kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names, text = docs.columns, docs.columns.index("text")

    def clean(batches):
        w = shared.value
        keep = w[:-1] != 0
        for batch in passes(batches, text):
            both = pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], ["doc_id", "text"])
            slot, doc = present(both, keep)
            s = np.bincount(doc, w[slot], minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s + w[-1], -35, 35)))
            yield batch.filter(pa.array(p < threshold))

    return docs.select(*names).mapInArrow(clean, docs.schema)
