"""Op 3. Sharding by Hilbert-curve order: quantise metadata dimensions, sort by curve index, cut runs.

Numeric dimensions are cut at approximate quantiles, categorical ones by the top bits of a checksum; the
curve index orders the rows, and shards are consecutive runs of equal row counts (law `rows`) or of
nearly equal bytes (law `bytes`), so each file covers a compact box of the metadata space. Ranks come
from a range partitioning: a row's place in its partition plus the rows of earlier partitions. No
window holds all rows, and ties on the curve are ordered by id, so a crowded cell is spread too.

Defined results: a null text has no bytes and the checksum of the empty text; null dimensions fall in
level 0; repeated rows get slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, partitions, table, tune

BITS = 5


def curve_index(levels: list[np.ndarray], bits: int) -> np.ndarray:
    """Hilbert index of points with `bits` bits a dimension (transpose form, Gray coded)."""
    x = [v.astype(np.int64).copy() for v in levels]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for k in range(n):
            has = (x[k] & q) > 0
            flip = (x[0] ^ x[k]) & p
            x[0] = np.where(has, x[0] ^ p, x[0] ^ flip)
            if k:
                x[k] = np.where(has, x[k], x[k] ^ flip)
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(n):
            out = (out << 1) | (((x[k] ^ t) >> b) & 1)
    return out


def with_curve(df: DataFrame, numeric: list[str], categorical: list[str], bits: int = BITS) -> DataFrame:
    """df with `curve`: the Hilbert index over the named columns."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*(F.percentile_approx(c, shares, 1000).alias(c) for c in numeric)).first()
    edges = [np.array(found[c] if found and found[c] is not None else [0.0], float) for c in numeric]

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        levels = [np.searchsorted(e, c.fillna(-np.inf).to_numpy(float), side="left") for e, c in zip(edges, cols)]
        levels += [c.to_numpy(np.int64) >> (32 - bits) for c in cols[len(edges) :]]
        return pd.Series(curve_index(levels, bits))

    codes = [F.coalesce(F.crc32(F.col(c).cast("string")), F.lit(0)).cast("long") for c in categorical]
    return df.withColumn("curve", index(*(F.col(c).cast("double") for c in numeric), *codes))


def ranked(df: DataFrame, *order: str | Column, size: str = "size") -> DataFrame:
    """df with `rank` (0-based place in the order), `before` (sum of `size` before it), `n` and `total`."""
    spark = df.sparkSession
    mid = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = durable(dealt.withColumns({"part": F.shiftright(mid, 33), "place": mid.bitwiseAND(F.lit((1 << 33) - 1))}))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    starts = sums.select(
        "part", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("byte0"),
        F.sum("rows").over(Window.partitionBy()).alias("n"), F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    # one row a partition: its size is the partition count
    return dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("row0") + F.col("place"))


def shard(df: DataFrame, numeric: list[str], categorical: list[str], tie: list[str], shards: int, law: str = "rows", size: str = "size") -> DataFrame:
    """df with shard and slot. law `rows`: counts at most one apart; `bytes`: cut at equal shares of `size`."""
    r = ranked(with_curve(df, numeric, categorical), "curve", *tie, size=size)
    if law == "rows":
        start = F.expr(f"(shard * n + {shards - 1}) div {shards}")
        return r.withColumn("shard", F.expr(f"rank * {shards} div n").cast("int")).withColumn("slot", F.col("rank") - start)
    if law != "bytes":
        raise ValueError(f"unknown law {law!r}")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("cum", F.col("byte0") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    r = durable(r.withColumn("shard", F.least(F.expr(f"cum * {shards} div greatest(total, 1)"), F.lit(shards - 1)).cast("int")))
    first = r.groupBy("shard").agg(F.min("rank").alias("first"))
    return r.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 10_000)
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard(docs, ["size", "doc_id"], ["source", "lang"], ["doc_id", "text_crc32", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
