"""Shared helpers: durable cut points, Arrow batch sizes and vectorised text arrays.

The text helpers turn one bounded Arrow batch into flat numpy arrays (bytes, tokens,
n-gram hashes). They hold no state; Spark partitions and shuffles all work.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass handles at once; longer single texts form a pass of their own.
PASS_BYTES = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-logloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/logloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # shuffle files of the finished part go once the driver drops its handles
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what `durable` wrote for these frames; nothing may read them afterwards."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs with `row_key`, unique; written, so that every read finds the same keys."""
    return durable(docs.withColumn("row_key", F.monotonically_increasing_id()))


def tune(spark: SparkSession, rows: int = 256) -> None:
    """Small Arrow batches, so that a Python worker's memory does not follow the partition's size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def passes(batches, column: int = 1):
    """Split Arrow batches into slices of about PASS_BYTES of the given text column, whole rows only."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // PASS_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, n]):
            yield batch.slice(start, end - start)


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
POWERS = _powers(0x9E3779B97F4A7C15, 1 << 12)

_kind = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 punctuation
_kind[[9, 10, 11, 12, 13, 32]] = 0
_kind[48:58] = _kind[65:91] = _kind[97:123] = _kind[128:] = 1
KIND = _kind
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Tokens:
    """Token arrays of one pass: hash, doc, kind (1 word, 2 punctuation run), shout flag."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, punctuation: bool):
        kind = KIND[raw]
        if not punctuation:
            kind = np.where(kind == 2, 0, kind)
        n = len(raw)
        new = np.empty(n, bool)
        if n:
            new[0] = True
            np.not_equal(kind[1:], kind[:-1], out=new[1:])
            new[off[:-1][off[:-1] < n]] = True
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, n))
        keep = kind[first] > 0
        start, length = first[keep], length[keep]
        self.kind = kind[start]
        self.doc = np.searchsorted(off, start, side="right") - 1
        self.n = len(start)
        self.raw, self.start, self.length = raw, start, length

    def hashes(self) -> np.ndarray:
        """Polynomial hash of each token's lower-cased bytes."""
        if not self.n:
            return np.zeros(0, U64)
        base = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum())) - np.repeat(base, self.length)
        at = place + np.repeat(self.start, self.length)
        value = BYTE_CODE[LOWER[self.raw[at]]] * POWERS[place & 4095]
        return mix(np.add.reduceat(value, base) + self.length.astype(U64))

    def shouting(self) -> np.ndarray:
        """Words of two or more ASCII capitals and no ASCII small letter."""
        if not self.n:
            return np.zeros(0, bool)
        up = np.concatenate([[0], np.cumsum((self.raw >= 65) & (self.raw < 91))])
        low = np.concatenate([[0], np.cumsum((self.raw >= 97) & (self.raw < 123))])
        end = self.start + self.length
        return (up[end] - up[self.start] >= 2) & (low[end] == low[self.start]) & (self.kind == 1)


def shingles(token_hash: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of each run of `size` words; a text of fewer words is one shingle of all of them."""
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    out_h, out_d = [], []
    if len(token_hash) >= size:
        m = len(token_hash) - size + 1
        h = np.zeros(m, U64)
        for k in range(size):
            h = h * U64(0x9E3779B97F4A7C15) + token_hash[k : k + m]
        ok = doc[:m] == doc[size - 1 :]
        out_h.append(mix(h[ok]))
        out_d.append(doc[:m][ok])
    begin = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < size)):
        h = U64(count[d])
        for x in token_hash[begin[d] : begin[d] + count[d]]:
            h = h * U64(0x9E3779B97F4A7C15) + x
        out_h.append(mix(np.array([h], U64)))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable") if len(out_h) > 1 else slice(None)
    return h[order], d[order]


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) with counts, ordered by doc then hash. Hashes keep their top 52 bits."""
    key = (doc.astype(U64) << U64(52)) | (h >> U64(12))
    key, n = np.unique(key, return_counts=True)
    return key & U64((1 << 52) - 1), (key >> U64(52)).astype(np.int64), n


np.seterr(over="ignore")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns with clashing names never reach an operator's joins."""
    return df.select(*names)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
