"""File inventories: listings with type, size and time, never the file contents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions.names import basename, extension, file_type

# Image-like extensions in the order in which they take precedence, and the
# result folders that are not searched for new outputs.
RASTER_EXTENSIONS = ["tif", "tiff", "png", "jpg", "jpeg", "czi"]
STACK_EXTENSION = "oir"
RESULT_DIRS = ["measurements", "masks", "labels", "qc", "logs"]


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, dir, depth, detected_type, size_bytes, mtime)`` of every file below ``root``.

    The file content column is never selected, so Spark only lists.
    """
    base = root.rstrip("/")
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    ).select("path", "length", "modificationTime")
    relative = F.regexp_replace(F.element_at(F.split("path", base.split(":")[-1] + "/"), -1), "^/", "")
    return listed.select(
        "path",
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"),
        (F.size(F.split(relative, "/")) - 1).alias("depth"),
        file_type(F.col("path")).alias("detected_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
    )


def scan_summary(inventory: DataFrame) -> DataFrame:
    """Counts for a prepare step: stacks at any depth, TIFFs at the top, folders with files."""
    return inventory.agg(
        F.count_if(F.col("detected_type") == STACK_EXTENSION).alias("oir_count"),
        F.count_if((F.col("detected_type") == "tiff") & (F.col("depth") == 0)).alias("tiff_count"),
        F.countDistinct("dir").alias("directories_scanned"),
    )


def detect_images(inventory: DataFrame, limit: int | None = None) -> DataFrame:
    """Image-like files, one per case-insensitive name; the first ``limit`` of them if one is asked for.

    Raster files count at the top level and come in extension order, stacks at any depth come
    last. Duplicates fall to a partial-aggregated minimum; the limit is a top-k.
    """
    ext = extension(F.col("path"))
    rank = F.array_position(F.array(*[F.lit(e) for e in RASTER_EXTENSIONS]), ext)
    found = inventory.select(
        "path",
        basename(F.col("path")).alias("name"),
        F.when((rank > 0) & (F.col("depth") == 0), rank)
        .when(ext == STACK_EXTENSION, F.lit(len(RASTER_EXTENSIONS) + 1))
        .cast("int")
        .alias("priority"),
    ).filter(F.col("priority").isNotNull())
    first = found.groupBy(F.lower("name").alias("key")).agg(
        F.min(F.struct("priority", "name", "path")).alias("f")
    )
    files = first.select("f.path", "f.name", "f.priority")
    return files if limit is None else files.orderBy("priority", "name", "path").limit(limit)


def discover_outputs(
    inventory: DataFrame,
    extensions: Sequence[str] = ("tif", "tiff"),
    exclude_dirs: Sequence[str] = tuple(RESULT_DIRS),
    relative: str = "relative_path",
) -> DataFrame:
    """Files of a kind, leaving out every path that passes through an excluded folder."""
    excluded = F.array(*[F.lit(d.lower()) for d in exclude_dirs])
    parts = F.split(F.lower(F.col(relative)), "/")
    inside = F.arrays_overlap(parts, excluded) if exclude_dirs else F.lit(False)
    return inventory.filter(extension(F.col(relative)).isin(*extensions) & ~inside)


def combine_inventories(parts: Sequence[DataFrame], key: str = "path") -> DataFrame:
    """Union of listings with repeated paths removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates([key])


def missing_paths(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Distinct rows of ``previous`` that ``current`` no longer has."""
    return previous.subtract(current.select(*previous.columns))


def file_pairs(inventory: DataFrame, output_dir: str) -> DataFrame:
    """Every stack file with the projected file expected for it."""
    from pixelframe.functions.names import projected_path

    return inventory.select(
        F.col("path").alias("input_path"),
        projected_path(F.col("path"), F.lit(output_dir)).alias("output_path"),
    )
