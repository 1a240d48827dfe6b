"""A stored trigram index over turns (F7, F8, Q2): which files can hold a needle, before any text is read.

Turns are written in `parts` folders by their session, so a session lies in one of them, and the index holds, for each three characters of lower-cased text, the parts that have them.
A search reads the index rows of its needles' trigrams alone (the index is sorted, so most of its row groups are skipped), then the folders that are left; the exact match comes after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import TextQuery, parse_query, sessions_with_text
from ..operators.search import hits

PARTS = 1024
SIZE = 3


def grams_of(needle: str) -> set[str]:
    low = needle.lower()
    return {low[k : k + SIZE] for k in range(len(low) - SIZE + 1)}


def distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, lower-cased text) -> each part's distinct grams of a batch. Every character is looked at once, so a long text costs no more than its length."""
    for batch in batches:
        seen: dict[int, set[str]] = {}
        for part, low in zip(*(c.to_pylist() for c in batch.columns)):
            seen.setdefault(part, set()).update([low[k : k + SIZE] for k in range(len(low) - SIZE + 1)])
        for part, grams in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(grams), pa.int32()), pa.array(list(grams), pa.string())], ["part", "gram"])


def build(turns: DataFrame, path: str, parts: int = PARTS, text: str = "text") -> None:
    """turns(session_key, ..., text) -> path/turns (by part) and path/index (gram, parts). A row of the index holds no more than `parts` numbers.

    A part that outgrows the advised partition size is written by several tasks; the index is made from the written turns, so the input is read once and by as many tasks as the turns fill.
    """
    placed = turns.withColumn("part", F.pmod(F.xxhash64("session_key"), F.lit(parts)).cast("int"))
    placed.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/turns")
    stored = turns.sparkSession.read.schema(placed.schema).parquet(f"{path}/turns")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pairs = stored.select("part", low.alias("low")).where(F.length("low") >= SIZE).mapInArrow(distinct_grams, "part int, gram string").distinct()
    index = pairs.groupBy("gram").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    index.repartitionByRange("gram").sortWithinPartitions("gram").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/index")


def candidates(spark: SparkSession, path: str, query: TextQuery) -> set[int] | None:
    """Parts that can hold a hit; None if the needles rule none out. Only index rows of the needles' trigrams reach the driver."""
    needles = [grams_of(n) for n in (*query.phrases, *query.terms)]
    if not needles or (not query.every and not all(needles)):
        return None  # no needle, or one that is too short to be looked up
    wanted = sorted(set().union(*needles))
    if not wanted:
        return None
    found = {r.gram: set(r.parts) for r in spark.read.parquet(f"{path}/index").where(F.col("gram").isin(*wanted)).collect()}
    each = [set.intersection(*(found.get(x, set()) for x in n)) for n in needles if n]
    return set.intersection(*each) if query.every else set.union(*each)


def pruned(spark: SparkSession, path: str, query: TextQuery) -> DataFrame:
    """The stored turns of all candidate parts."""
    turns = spark.read.parquet(f"{path}/turns")
    parts = candidates(spark, path, query)
    return (turns if parts is None else turns.where(F.col("part").isin(*sorted(parts)) if parts else F.lit(False))).drop("part")


def indexed_hits(spark: SparkSession, path: str, query: str, tool_output: bool = False) -> DataFrame:
    """Turns that match by themselves, as `search.hits` finds them over all turns."""
    return hits(pruned(spark, path, parse_query(query)), query, tool_output)


def indexed_sessions(spark: SparkSession, path: str, sessions: DataFrame, query: str) -> DataFrame:
    """Sessions whose text matches, as `sessions_with_text` finds them over all blocks; the stored rows are blocks then."""
    q = parse_query(query)
    return sessions_with_text(sessions, pruned(spark, path, q), q) if q.has_text else sessions
