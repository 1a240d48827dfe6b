"""The given conversations as growing logs: every batch is written and read by several tasks."""

from pyspark.sql import functions as F

from logloom.plans.log_lines import tool_a_lines
from logloom.streaming import growing


def test_batches_are_files_of_several_tasks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "shared_folder", lambda _: str(tmp_path))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        growing.grown_changes(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    (folder,) = tmp_path.glob("logloom-grown-*")
    lines = spark.read.parquet(str(folder / "lines"))
    assert lines.select(F.input_file_name()).distinct().count() > growing.BATCHES
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, tool_a_lines(spark, sf_dir).collect()))
    assert {p.name for p in (folder / "state" / "commits").iterdir() if not p.name.startswith(".")} == {str(k) for k in range(growing.BATCHES)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffles
