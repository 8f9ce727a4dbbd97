"""Incremental jobs: new planes, their measurements, and log errors as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelframe.durable import passing_tables
from pixelframe.operators.logs import EXCEPTION_LINE, MODULE_LINE, PIPELINE_ERROR_MARKERS, any_of, strip
from pixelframe.plans.pipeline import run_batch
from pixelframe.sources.planes import PLANES_SCHEMA


def stream_new_planes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Planes of files not seen before; the checkpoint of the query remembers the rest."""
    reader = spark.readStream.schema(PLANES_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_measure(
    planes: DataFrame, output: str, checkpoint: str, **parameters: Any
) -> StreamingQuery:
    """Segment and measure each batch of new planes.

    A batch writes to its own ``batch=<id>`` folder in overwrite mode, so a batch repeated
    after a failure replaces its rows instead of adding them again. Intermediate tables go with their batch.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        with passing_tables(batch.sparkSession):
            result = run_batch(batch, **parameters)
            if result.measurements is not None:
                result.measurements.write.mode("overwrite").parquet(f"{output}/measurements/batch={batch_id}")
            result.summary.write.mode("overwrite").parquet(f"{output}/summary/batch={batch_id}")

    return (
        planes.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# One version of a file: when it was listed (microseconds), its size and its time of change (microseconds).
VERSION = "listed long, size long, modified long"


def _newer_version(
    key: tuple[str], listings: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    known = state.get if state.exists else None
    newest = known
    for rows in listings:
        latest = rows.loc[[rows["listed"].idxmax()]].astype(object)
        latest = tuple(None if pd.isna(v) else int(v) for v in latest[["listed", "size", "modified"]].iloc[0])
        if newest is None or latest[0] > newest[0]:
            newest = latest
    if newest is known:
        return
    state.update(newest)
    if known is None or newest[1:] != known[1:]:
        change = "new" if known is None else "changed"
        row = pd.DataFrame([(key[0], *newest, change)], columns=["path", "listed", "size", "modified", "change"])
        yield row.astype({"size": "Int64", "modified": "Int64"})


def stream_changed_files(listings: DataFrame) -> DataFrame:
    """``(path, size, modified, listed, change)``: files to be processed, from a stream of listings of a folder.

    ``listings`` holds ``path, size, modified, listed``. State per path is the version last listed, so a file that is
    written again comes out as ``changed``, also if an earlier version returns, and an equal one does not. Of several
    listings in a batch the newest counts; one older than what is known is late and passed over. Rows without a path or
    time of listing are left out; an unknown size or time equals only another unknown one.
    """
    rows = listings.where("path IS NOT NULL AND listed IS NOT NULL").select(
        "path",
        F.unix_micros("listed").alias("listed"),
        F.col("size").cast("bigint").alias("size"),
        F.unix_micros("modified").alias("modified"),
    )
    versions = rows.groupBy("path").applyInPandasWithState(
        _newer_version,
        f"path string, {VERSION}, change string",
        VERSION,
        "append",
        GroupStateTimeout.NoTimeout,
    )
    times = {c: F.timestamp_micros(c) for c in ("listed", "modified")}
    return versions.withColumns(times).select("path", "size", "modified", "listed", "change")


def stream_log_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error-like lines of arriving logs, tagged by kind; stateless."""
    lines = spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("line")
    )
    marker = any_of(F.lower("line"), PIPELINE_ERROR_MARKERS)
    kind = (
        F.when(F.col("line").rlike(MODULE_LINE), "module")
        .when(F.col("line").rlike(EXCEPTION_LINE), "exception")
        .when(marker, "marker")
    )
    return lines.withColumn("kind", kind).filter(F.col("kind").isNotNull())
