"""Run logs as line tables ``(file, pos, line)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files with positions that follow the order of each file.

    Large files are read in parallel blocks. A line's position is the byte offset of its block
    plus its index in the block: increasing within the file and unique, because every line
    takes at least one byte.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    first = lines.groupBy("file", "_block").agg(F.min("_seq").alias("_first"))
    return lines.join(first, ["file", "_block"]).select(
        "file", (F.col("_block") + F.col("_seq") - F.col("_first")).alias("pos"), "line"
    )


def prefer_files(from_files: DataFrame, captured: DataFrame) -> DataFrame:
    """Text on disk wins over captured text, stream by stream ``(run_id, stream)``."""
    on_disk = from_files.select("run_id", "stream").distinct()
    return from_files.unionByName(captured.join(on_disk, ["run_id", "stream"], "left_anti"))
