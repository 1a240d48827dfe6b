"""The given conversations as logs that grow: the last lines of each session arrive first, then the others, so that every session is corrected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.log_lines import tool_a_lines
from ..sources.scratch import shared_folder
from .sessions import current_sessions, session_changes, with_state_store

BATCHES = 3


def grown_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of all sessions after the lines have come in BATCHES batches: each is appended to the logs and followed by a stream that goes on from its checkpoint."""
    root = shared_folder(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{root.rstrip('/')}/logloom-grown-{uuid.uuid4().hex}"
    lines = tool_a_lines(spark, sf_dir)
    batch = F.pmod(F.floor(F.col("line") / 10), F.lit(BATCHES)).cast("int")
    # rendered once; a batch is as many files as its lines fill, so that all cores write and read it
    batched = lines.withColumn("batch", batch)
    batched.repartition("source_path").write.partitionBy("batch").option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.schema(batched.schema).parquet(f"{folder}/staged")
    with_state_store(spark)
    for k in reversed(range(BATCHES)):  # the last lines of a session come first
        staged.where(F.col("batch") == k).select(*lines.columns).write.mode("append").parquet(f"{folder}/lines")
        changes = session_changes(spark.readStream.schema(lines.schema).parquet(f"{folder}/lines"), "claude-code")
        run_to_end(changes, folder)
    return spark.read.schema(changes.schema).parquet(f"{folder}/changes")


def run_to_end(changes: DataFrame, folder: str) -> None:
    """The stream with what has arrived, in one micro-batch. Each partition of its state costs a worker and a store a batch, so there are two a core, if not fewer are set."""
    spark = changes.sparkSession
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(held), 2 * spark.sparkContext.defaultParallelism))
    try:
        query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    if query.exception() is not None:
        raise query.exception()


def grown_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_sessions(grown_changes(spark, sf_dir))
