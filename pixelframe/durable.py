"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_folder: str | None = None
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)

#: Rows above which a written table is joined by shuffling, never sent through the driver as a broadcast.
SPREAD_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; an own one only in local mode."""
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-pixelframe-")
    return _local_folder


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows, to be joined by shuffling if they are many.

    Estimates go by file sizes, and a table of a few MB in files (ids and counts pack well) can be 100 times as large in
    memory. A union drops the hint of its sides; give it anew.
    """
    return df.hint("merge") if rows > SPREAD_ROWS else df


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table rather than ``checkpoint()``: the columns stay prunable, sizes are known to
    the optimizer, and no predicates of earlier rounds are carried into iterative plans. Large tables are never
    broadcast (:func:`spread`); the writing job counts the rows.
    """
    return _written(df)[0]


def discard(written: DataFrame) -> None:
    """Remove a table of :func:`durable` that no later plan reads."""
    _remove(written.sparkSession, written._durable_path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables :func:`durable` wrote inside the block when it ends; results must be stored by then."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            _remove(spark, path)


def durable_counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`durable` with the number of (matching) rows, counted by the writing job itself."""
    return _written(df, F.lit(True) if condition is None else condition)


def _written(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pixelframe/{uuid.uuid4().hex}"
    if (paths := _passing.get()) is not None:
        paths.append(path)
    seen = Observation()
    matching = F.lit(0) if condition is None else F.count_if(condition)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), matching.alias("matching")).write.parquet(path)
    counts = seen.get
    written = spread(spark.read.schema(df.schema).parquet(path), counts["rows"])
    written._durable_path = path
    return written, counts["matching"]
