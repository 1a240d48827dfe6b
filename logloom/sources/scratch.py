"""Frames written once to the folder that driver and executors share, so that several readers don't derive them anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, else the context's checkpoint folder, else a temporary one under local[...], else none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root and spark.sparkContext.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="spark-logloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(frame: DataFrame) -> DataFrame:
    """frame, written as Parquet and read back; without a shared folder the frame itself, which then is derived by each reader."""
    spark = frame.sparkSession
    root = shared_folder(spark)
    if root is None:
        return frame
    path = f"{root.rstrip('/')}/logloom-events-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
