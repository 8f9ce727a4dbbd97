"""Per-image statistics, quality estimates and the projected-image audit.

All statistics read the plane's own array, so these operators are narrow projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.arrays import (
    bind,
    height,
    mean,
    percentile_of_sorted,
    stddev_pop,
    total,
    width,
)
from pixelframe.operators.pixelwise import to_uint16
from pixelframe.operators.watershed import distance_transform


# Texts of image limitations and mask warnings, as stored in reports.
LIMITATION_CHANNELS = "Multi-channel image: lightweight Python mode uses one channel only."
LIMITATION_SNR = "Low estimated SNR: thresholding may be unstable."
LIMITATION_RANGE = "Low dynamic range: weak foreground/background separation."
LIMITATION_SIZE = "Large image size: processing may be slow or memory-heavy."
WARNING_EMPTY = "Threshold produced almost no foreground."
WARNING_FULL = "Threshold produced excessive foreground."


def _with_columns_from(df: DataFrame, stats: Column, fields: list[str]) -> DataFrame:
    """Evaluate one struct expression and spread its fields into columns."""
    return df.withColumn("_stats", stats).withColumns(
        {name: F.col("_stats").getField(name) for name in fields}
    ).drop("_stats")


def inspect_image(planes: DataFrame) -> DataFrame:
    """Range, mean, background deviation, contrast-to-noise estimate and limitation flags.

    An optional ``channel_count`` column (from the file's shape) flags multi-channel sources.
    """
    return with_inspection(planes).select(
        "image_id",
        "height",
        "width",
        "dtype",
        "min_value",
        "max_value",
        "dynamic_range",
        "mean_intensity",
        "background_std",
        "estimated_snr",
        "channel_count",
        "limitations",
    )


def with_inspection(planes: DataFrame) -> DataFrame:
    """Planes with what :func:`inspect_image` finds beside their own columns; narrow."""
    channels = F.col("channel_count") if "channel_count" in planes.columns else F.lit(1)

    def measure(s: Column) -> Column:
        quarter = percentile_of_sorted(s, 0.25)
        background = bind(
            bind(quarter, lambda q: F.filter(s, lambda v: v <= q)), lambda b: stddev_pop(b)
        )
        return F.struct(
            F.get(s, F.lit(0)).alias("min_value"),
            F.element_at(s, -1).alias("max_value"),
            mean(s).alias("mean_intensity"),
            F.coalesce(background, F.lit(0.0)).alias("background_std"),
            (percentile_of_sorted(s, 0.9) - percentile_of_sorted(s, 0.5)).alias("contrast"),
        )

    stats = _with_columns_from(
        planes,
        bind(F.sort_array("pixels"), measure),
        ["min_value", "max_value", "mean_intensity", "background_std", "contrast"],
    )
    rated = stats.withColumns(
        {
            "dynamic_range": F.col("max_value") - F.col("min_value"),
            "estimated_snr": F.when(
                F.col("background_std") > 0, F.col("contrast") / F.col("background_std")
            ),
            "channel_count": channels.cast("int"),
        }
    )
    limitations = F.array_compact(
        F.array(
            F.when(F.col("channel_count") > 1, F.lit(LIMITATION_CHANNELS)),
            F.when(F.col("estimated_snr") < 3.0, F.lit(LIMITATION_SNR)),
            F.when(F.col("dynamic_range") < 100, F.lit(LIMITATION_RANGE)),
            F.when(F.greatest(height(), width()) > 4096, F.lit(LIMITATION_SIZE)),
        )
    )
    return rated.withColumn("limitations", limitations)


def vignette_expr() -> Column:
    """Relative darkness of the four corners against the median of the field.

    Corner index lists are concatenated, so on tiny planes overlapping corners count twice.
    """
    margin = F.greatest(F.lit(4), F.floor(F.least(height(), width()) / 16)).cast("int")

    def ends(n: Column, m: Column) -> Column:
        return F.concat(
            F.sequence(F.lit(0), F.least(m, n) - 1), F.sequence(F.greatest(n - m, F.lit(0)), n - 1)
        )

    def score(p: Column) -> Column:
        corners = bind(
            margin,
            lambda m: bind(
                ends(width(), m),
                lambda xs: F.flatten(
                    F.transform(
                        ends(height(), m), lambda y: F.transform(xs, lambda x: F.get(p, y * width() + x))
                    )
                ),
            ),
        )
        return bind(
            F.struct(
                bind(corners, lambda c: mean(c)).alias("corner"),
                bind(F.sort_array(p), lambda s: percentile_of_sorted(s, 0.5)).alias("field"),
            ),
            lambda t: F.when(
                (t["field"] <= 0) | (t["corner"] >= t["field"] * 0.95), F.lit(0.0)
            ).otherwise((t["field"] - t["corner"]) / t["field"]),
        )

    return bind(F.col("pixels"), score)


def vignette_score(planes: DataFrame) -> DataFrame:
    return planes.select("image_id", vignette_expr().alias("vignette_score"))


def odd_clamp(value: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and move an even result to an odd neighbour inside the range."""
    clipped = F.least(F.greatest(value, low), high).cast("int")
    odd = F.when(clipped % 2 != 0, clipped).when(clipped < high, clipped + 1).otherwise(clipped - 1)
    return F.greatest(odd, low).cast("int")


def estimate_block_size(masked: DataFrame) -> DataFrame:
    """Adds ``block_size``: odd local window from the typical object radius.

    ``masked`` has the coarse Otsu ``mask``. The radius is the 75th percentile of the
    foreground distances; without foreground half of the largest window is used.
    """
    low, high = F.lit(15), odd_clamp(F.floor(F.least(height(), width()) / 4), F.lit(15), F.lit(101))
    radius = bind(
        F.sort_array(F.filter("distance", lambda d: d > 0)),
        lambda s: F.when(F.size(s) > 0, percentile_of_sorted(s, 0.75)),
    )
    with_radius = distance_transform(masked).withColumn("_radius", radius)
    diameter = F.greatest(F.lit(6.0), F.col("_radius") * 2.0)
    block = F.when(
        F.col("_radius").isNull(), odd_clamp(F.floor(high / 2), low, high)
    ).otherwise(odd_clamp(F.rint(diameter * 3.0), low, high))
    return with_radius.withColumn("block_size", block).drop("_radius", "distance")


def offset_expr() -> Column:
    """A quarter of the deviation of the darkest 30 % of pixels."""
    return bind(
        F.sort_array("pixels"),
        lambda s: bind(
            percentile_of_sorted(s, 0.30),
            lambda q: bind(
                F.filter(s, lambda v: v <= q),
                lambda b: F.greatest(F.lit(0.0), F.coalesce(stddev_pop(b), F.lit(0.0)) * 0.25),
            ),
        ),
    )


def estimate_offset(planes: DataFrame) -> DataFrame:
    return planes.select("image_id", offset_expr().alias("offset"))


def min_size_expr(block_size: Column, default: int) -> Column:
    """Smallest plausible object area for a window, never below ``default``."""
    radius = F.greatest(F.lit(3), F.floor(block_size / 6))
    area = F.floor(F.pi() * radius * radius * 0.35)
    ceiling = F.greatest(F.lit(default), F.floor(height() * width() / 20))
    return F.least(F.greatest(F.lit(default), area), ceiling).cast("int")


def estimate_min_size(blocks: DataFrame, default: int = 20) -> DataFrame:
    return blocks.select("image_id", min_size_expr(F.col("block_size"), default).alias("min_size"))


def foreground_fraction(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m)) / F.size(mask)


def sanity_warning(fraction: Column) -> Column:
    """Null for a plausible foreground fraction, otherwise the warning text."""
    return F.when(fraction <= 0.0005, F.lit(WARNING_EMPTY)).when(
        fraction >= 0.55, F.lit(WARNING_FULL)
    )


def mask_sanity(masked: DataFrame, mask: str = "mask") -> DataFrame:
    fraction = masked.select("image_id", foreground_fraction(F.col(mask)).alias("foreground_fraction"))
    warning = sanity_warning(F.col("foreground_fraction"))
    return fraction.select("*", warning.isNull().alias("sane"), warning.alias("warning"))


def choose_method(snr: Column, vignette: Column) -> Column:
    """Primary threshold method of an image; a missing contrast estimate is null."""
    return (
        F.when(snr < 3.0, "sauvola")
        .when((vignette < 0.05) & (snr.isNull() | (snr >= 4.0)), "otsu")
        .when((snr >= 6.0) & (vignette < 0.12), "otsu")
        .otherwise("local")
    )


def score_confidence(
    snr: Column, warnings: Column, fallback_used: Column, object_count: Column
) -> Column:
    empty = F.exists(warnings, lambda w: w.contains("almost no foreground"))
    return (
        F.when((object_count == 0) | empty, "low")
        .when(fallback_used | F.coalesce(snr < 3.0, F.lit(False)), "medium")
        .when((snr >= 5.0) & (F.size(warnings) == 0), "high")
        .otherwise("medium")
    )


def _range_stats(pixels: Column) -> Column:
    return F.struct(
        F.coalesce(F.array_min(pixels), F.lit(0.0)).alias("min"),
        F.coalesce(F.array_max(pixels), F.lit(0.0)).alias("max"),
        F.size(F.filter(pixels, lambda v: v != 0)).cast("bigint").alias("nonzero"),
    )


def describe_projected(planes: DataFrame) -> DataFrame:
    """Shape, dtype, range, non-zero count and channel count of projected planes."""
    channels = F.col("channel_count") if "channel_count" in planes.columns else F.lit(1)
    return planes.withColumn("_s", _range_stats(F.col("pixels"))).select(
        "image_id",
        "height",
        "width",
        "dtype",
        F.col("_s.min").alias("min"),
        F.col("_s.max").alias("max"),
        F.col("_s.nonzero").alias("nonzero"),
        F.greatest(F.lit(1), channels.cast("int")).alias("channel_count"),
    )


def postprocess_projected(
    planes: DataFrame, engine: str, preserved_engines: tuple[str, ...] = ("fiji",)
) -> DataFrame:
    """Range before and after 16-bit conversion, the rule applied, and whether data changed.

    Output of a preserved engine is reported untouched. ``pixels`` holds the result, so a
    writer can filter on ``rewritten`` and skip identical files.
    """
    source = planes.withColumns({"_before": F.col("pixels"), "_dtype": F.col("dtype")})
    if engine in preserved_engines:
        done = source.withColumn("action", F.lit(f"{engine}_preserved"))
    else:
        done = to_uint16(source)
    changed = (F.col("_dtype") != F.col("dtype")) | (F.col("_before") != F.col("pixels"))
    audited = done.withColumns(
        {
            "_b": _range_stats(F.col("_before")),
            "_a": _range_stats(F.col("pixels")),
            "rewritten": changed,
        }
    )
    return audited.select(
        "image_id",
        F.lit(engine).alias("engine"),
        "height",
        "width",
        F.col("_dtype").alias("dtype_before"),
        F.col("_b.min").alias("min_before"),
        F.col("_b.max").alias("max_before"),
        F.col("_b.nonzero").alias("nonzero_before"),
        F.col("dtype").alias("dtype_after"),
        F.col("_a.min").alias("min_after"),
        F.col("_a.max").alias("max_after"),
        F.col("_a.nonzero").alias("nonzero_after"),
        "action",
        "rewritten",
        "pixels",
    )


__all__ = [
    "choose_method",
    "describe_projected",
    "estimate_block_size",
    "estimate_min_size",
    "estimate_offset",
    "foreground_fraction",
    "inspect_image",
    "mask_sanity",
    "odd_clamp",
    "postprocess_projected",
    "score_confidence",
    "total",
    "vignette_score",
]
