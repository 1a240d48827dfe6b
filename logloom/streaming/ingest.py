"""Streaming forms (ST1, ST2): files that arrive or grow become session changes, and running stats follow the changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalise
from ..operators.stats import facts
from ..sources import agent_logs
from ..sources.logs import numbered, size_guard
from .sessions import session_changes, with_state_store


def ingest(spark: SparkSession, path: str, tool: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each new file is normalised once and its sessions handed to `sink(sessions, batch id)`; ends when all there is has been read.

    For files that are complete when they arrive; `follow` takes lines that are appended later.
    """
    m = F.col("_metadata")
    lines = spark.readStream.text(path).select("value", m["file_path"].alias("source_path"), m["file_size"].alias("file_size"), m["file_block_start"].alias("block_start"))

    def each(batch: DataFrame, k: int) -> None:
        small, big = size_guard(batch)
        sink(normalise(numbered(small), tool, files=batch, too_large=big).sessions, k)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, root: str, tool: str, checkpoint: str, changes: str, **options) -> StreamingQuery:
    """Reads what was appended to the tool's files since the last run and appends the changes of their sessions, as Parquet, to the folder `changes`."""
    with_state_store(spark)
    raw = agent_logs.load(spark, tool, root, stream=True, **options)
    lines = raw.where("error IS NULL").select("source_path", F.col("start").alias("line"), "value").where(F.col("value").rlike(r"\S"))
    return session_changes(lines, tool).writeStream.format("parquet").option("path", changes).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed_facts(changes: DataFrame) -> DataFrame:
    """Session changes -> sign, tool, day, turns, tokens."""
    return facts(changes, "", "sign")


def running_stats(sessions: DataFrame) -> DataFrame:
    """sessions(tool, day, turns, tokens) -> counts by day and tool, update mode; state is a row a day and tool.

    With a column `sign`, rows of sign -1 take back what they once added, so the counts follow sessions that change, days included. A day that nothing is left of counts 0.
    """
    sign = F.col("sign") if "sign" in sessions.columns else F.lit(1)
    total = lambda c: F.sum(c * sign).cast("bigint")
    return sessions.groupBy("day", "tool").agg(total(F.lit(1)).alias("sessions"), total(F.col("turns")).alias("turns"), total(F.col("tokens")).alias("tokens"))
