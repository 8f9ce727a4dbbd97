"""Writers for measurements, reports and image layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.layers import layer_name
from pixelframe.operators.measure import export_names


def write_measurements(
    df: DataFrame, path: str, fmt: str = "csv", per_image: bool = False, mode: str = "overwrite"
) -> None:
    """Object rows with a header; ``per_image`` adds one folder per image."""
    writer = export_names(df).write.mode(mode)
    if per_image:
        writer = writer.partitionBy("image_id")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested report rows as JSON lines; null sections stay visible."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_layers(df: DataFrame, kind: str, path: str, mode: str = "append") -> None:
    """Planes of one kind under ``kind=…/stack_id=…`` with their layer file name."""
    source = F.col("source_path") if "source_path" in df.columns else F.lit(None).cast("string")
    named = df.withColumns(
        {"layer_name": layer_name(source, F.col("frame_index"), kind), "kind": F.lit(kind)}
    )
    named.write.mode(mode).partitionBy("kind", "stack_id").parquet(path)


def write_bucketed_planes(df: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Planes bucketed on ``image_id``: per-image joins and aggregates then need no exchange."""
    df.write.mode(mode).bucketBy(buckets, "image_id").sortBy("image_id").saveAsTable(table)
