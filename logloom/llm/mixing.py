"""Op 9. Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Sizes are summed by source; weights turn into targets by water filling (a source never passes its cap).
A source's target is whole repeats of all its documents plus a remainder; the remainder is met by a hash
threshold found without sorting: sizes are summed by (source, hash bucket), the bucket that holds the
budget is found from running sums, and only that bucket's rows are summed again by the next bits.
A document is taken once more if its hash lies below the threshold, so smaller budgets are nested.

Sources are few against documents: up to BROADCAST_SOURCES of them (counted first) their rows are broadcast, so that a source
with a third of all documents is no hot key; beyond that they are joined by shuffles. Windows run over sources only.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own, last;
a row without an id is told apart by its text; rows of one id (or of none and one text) share a hash and are taken alike; no
row is repeated more than the cap; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL, CAP = 1.5, 2
#: Bits of the hash and bits that one refinement adds.
BITS, STEP = 60, 12
BROADCAST_SOURCES = 50_000


def hash60(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """sizes(key, size) -> key, source_size, target: one row a source; windows run over sources, not rows."""
    by_name, by_ratio = Window.orderBy("key"), Window.orderBy("ratio", "key")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * cap, "ratio": F.col("source_size") * cap / F.col("weight"), "goal": F.sum("source_size").over(everything) * F.lit(total)})
    s = s.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"])
    return s.select("key", "source_size", F.least(F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """docs(key, size, h, ...) and goal(key, source_size, target) -> docs with source_size, target, repeats."""
    small = F.broadcast if goal.count() <= BROADCAST_SOURCES else (lambda df: df)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    edge = goal.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))
    for shift in range(BITS - STEP, -1, -STEP):
        at = F.shiftright("h", shift)
        parts = docs.select("key", "size", "h").join(small(edge.select("key", "prefix")), "key").where(F.shiftright(at, STEP) == F.col("prefix"))
        sums = parts.groupBy("key", at.alias("bucket")).agg(F.sum("size").alias("inside"))
        w = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.join(small(edge.select("key", "budget", "below")), "key").withColumn("below", F.col("below") + F.coalesce(F.sum("inside").over(w), F.lit(0)))
        first = F.struct("bucket", "below", "inside")
        found = sums.groupBy("key", "budget").agg(
            F.coalesce(F.min(F.when(F.col("below") + F.col("inside") > F.col("budget"), first)), F.max(first)).alias("at")
        )
        edge = durable(found.select("key", "budget", F.col("at.bucket").alias("prefix"), F.col("at.below").alias("below"), F.col("at.inside").alias("inside")))
    with_edge = F.col("below") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("below")
    last = edge.select("key", F.col("prefix").alias("edge"), with_edge.alias("with_edge"))
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("with_edge"))
    joined = docs.join(small(goal.select("key", "source_size", "target", "whole").join(last, "key", "left")), "key")
    repeats = F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")
    return joined.withColumn("repeats", F.least(repeats, F.lit(cap)).cast("long")).drop("whole", "edge", "with_edge")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, key (source with null last), size in words, h, and the named columns."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", key.alias("key"), size.alias("size"), F.coalesce(hash60(F.col("doc_id")), hash60(F.col("text")), F.lit(0)).alias("h"), *more)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable(keyed(table(spark, sf_dir, "documents")))
    mixed = mix(docs, durable(targets(docs)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


_WATER = """
 sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h{more} FROM {docs}),
 s1 AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
 s2 AS (SELECT *, ([3, 1, 2])[CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s1),
 s3 AS (SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS goal FROM s2),
 s4 AS (SELECT *, (goal - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
   FROM s3 WINDOW w AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s5 AS (SELECT key, source_size, least(coalesce((SELECT arg_min(level, struct_pack(ratio := ratio, key := key)) FROM s4 WHERE level < ratio), 0.0) * weight, CAST(cap AS DOUBLE)) AS target FROM s4),
 s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s5),
 s7 AS (SELECT key, source_size, target, whole, target - whole * source_size AS budget FROM s6),
 hashes AS (SELECT key, h, CAST(sum(size) AS BIGINT) AS inside FROM sized GROUP BY key, h),
 running AS (SELECT *, coalesce(sum(inside) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM hashes),
 more AS (SELECT r.key, r.h FROM running r JOIN s7 USING (key)
   WHERE below + inside <= budget OR (below <= budget AND below + inside - budget < budget - below)),
 mixed AS (SELECT d.*, s7.source_size, s7.target, CAST(s7.whole + CASE WHEN m.h IS NULL THEN 0 ELSE 1 END AS BIGINT) AS repeats
   FROM sized d JOIN s7 USING (key) LEFT JOIN more m ON m.key = d.key AND m.h = d.h)
"""

ORACLE = "WITH " + _WATER.format(more="", docs="documents").strip() + "\nSELECT doc_id, size, source_size, target, size * repeats AS taken FROM mixed"
