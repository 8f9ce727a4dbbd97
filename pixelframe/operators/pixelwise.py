"""Pixel-wise operators on planes: thresholds, normalisation, dtype rules, overlays.

Per-image statistics come from the plane's own array, so every operator is one narrow
projection: no aggregation, no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.arrays import bind, percentile_of_sorted

UINT16_MAX = 65_535

# Cyclic RGB palette for label overlays, label 1 takes the second entry.
LABEL_PALETTE = [
    (255, 0, 0),
    (0, 0, 255),
    (255, 255, 0),
    (255, 0, 255),
    (0, 128, 0),
    (75, 0, 130),
    (255, 140, 0),
    (0, 255, 255),
    (255, 192, 203),
    (154, 205, 50),
]


def manual_threshold(planes: DataFrame, value: float) -> DataFrame:
    """``v >= value``, the bound belongs to the mask."""
    return planes.withColumn("mask", F.transform("pixels", lambda v: v >= F.lit(float(value))))


def normalize_image(planes: DataFrame) -> DataFrame:
    """Min-max scaling to [0, 1]; a constant plane becomes all zero."""
    scaled = bind(
        F.struct(F.array_min("pixels").alias("lo"), F.array_max("pixels").alias("hi")),
        lambda s: F.transform(
            "pixels",
            lambda v: F.when(s["lo"] == s["hi"], F.lit(0.0)).otherwise(
                (v - s["lo"]) / (s["hi"] - s["lo"])
            ),
        ),
    )
    return planes.withColumns({"pixels": scaled, "dtype": F.lit("float64")})


def _percentile_range(low: float, high: float) -> Column:
    return bind(
        F.sort_array("pixels"),
        lambda s: F.struct(
            percentile_of_sorted(s, low).alias("lo"), percentile_of_sorted(s, high).alias("hi")
        ),
    )


def _unit(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def normalize_for_display(planes: DataFrame) -> DataFrame:
    """Adds ``display``: 1st–99th percentile stretched to 0–255, truncated."""
    display = bind(
        _percentile_range(0.01, 0.99),
        lambda s: bind(
            F.when(s["hi"] <= s["lo"], s["lo"] + 1.0).otherwise(s["hi"]),
            lambda hi: F.transform(
                "pixels", lambda v: F.floor(_unit((v - s["lo"]) / (hi - s["lo"])) * 255).cast("int")
            ),
        ),
    )
    return planes.withColumn("display", display)


def normalize_robust(planes: DataFrame) -> DataFrame:
    """1st–99.5th percentile stretched to [0, 1]; a degenerate range becomes all zero."""
    scaled = bind(
        _percentile_range(0.01, 0.995),
        lambda s: F.transform(
            "pixels",
            lambda v: F.when(s["hi"] <= s["lo"], F.lit(0.0)).otherwise(
                _unit((v - s["lo"]) / (s["hi"] - s["lo"]))
            ),
        ),
    )
    return planes.withColumns({"pixels": scaled, "dtype": F.lit("float32")})


def uint16_action(dtype: Column, low: Column, high: Column) -> Column:
    """Which conversion rule applies to a plane of this dtype and range."""
    peak = F.greatest(high, F.lit(0.0))
    return (
        F.when(dtype == "uint16", "unchanged_uint16")
        .when(dtype == "uint8", "uint8_promoted_to_uint16")
        .when(
            dtype.startswith("float"),
            F.when(peak <= 1.0, "float01_scaled_to_uint16")
            .when(peak <= UINT16_MAX, "float_intensity_clipped_to_uint16")
            .otherwise("float_intensity_scaled_to_uint16"),
        )
        .when(
            dtype.rlike("^u?int"),
            F.when((high <= UINT16_MAX) & (low >= 0), "integer_cast_to_uint16")
            .when(peak <= UINT16_MAX, "integer_clipped_to_uint16")
            .otherwise("integer_scaled_to_uint16"),
        )
        .otherwise("cast_to_uint16")
    )


def to_uint16(planes: DataFrame) -> DataFrame:
    """Convert to the 16-bit range by rule; adds ``action`` and sets ``dtype``.

    Unit-range and over-range data are scaled and truncated; float intensities already in
    range round half to even; negatives clip to zero.
    """
    action = uint16_action(F.col("dtype"), F.array_min("pixels"), F.array_max("pixels"))

    def convert(rule: Column, peak: Column, v: Column) -> Column:
        v0 = F.greatest(v, F.lit(0.0))
        return (
            F.when(rule == "float01_scaled_to_uint16", F.floor(v0 * UINT16_MAX).cast("double"))
            .when(rule == "float_intensity_clipped_to_uint16", F.rint(v0))
            .when(
                rule.endswith("_scaled_to_uint16"),
                F.floor(F.least(v0 * (F.lit(float(UINT16_MAX)) / peak), F.lit(float(UINT16_MAX)))).cast(
                    "double"
                ),
            )
            .when(rule == "integer_clipped_to_uint16", v0)
            .otherwise(v)
        )

    converted = bind(
        F.struct(action.alias("rule"), F.array_max("pixels").alias("peak")),
        lambda s: F.transform("pixels", lambda v: convert(s["rule"], s["peak"], v)),
    )
    return planes.withColumn("action", action).withColumns(
        {"pixels": converted, "dtype": F.lit("uint16")}
    )


def encode_mask(planes: DataFrame, mask: str = "mask") -> DataFrame:
    """Boolean mask → 0/255 plane."""
    return planes.withColumns(
        {
            "pixels": F.transform(mask, lambda m: F.when(m, F.lit(255.0)).otherwise(F.lit(0.0))),
            "dtype": F.lit("uint8"),
        }
    )


def label_dtype(max_label: Column) -> Column:
    """Smallest unsigned type that holds every label; an empty image takes the small one."""
    return F.when(F.coalesce(max_label, F.lit(0)) <= UINT16_MAX, "uint16").otherwise("uint32")


def encode_intensity(planes: DataFrame) -> DataFrame:
    """Integers, booleans and float32 pass; any other type becomes float32."""
    keep = F.col("dtype").rlike("^u?int") | F.col("dtype").isin("bool", "float32")
    return planes.withColumns(
        {
            "pixels": F.when(keep, F.col("pixels")).otherwise(
                F.transform("pixels", lambda v: v.cast("float").cast("double"))
            ),
            "dtype": F.when(keep, F.col("dtype")).otherwise("float32"),
        }
    )


def _check_alpha(alpha: float) -> None:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be between 0 and 1")


def _same_size(other: str, what: str) -> Column:
    return F.when(
        F.size(other) == F.size("pixels"), F.lit(True)
    ).otherwise(F.raise_error(F.lit(f"{what} shape must match image shape")).cast("boolean"))


def mask_overlay(
    planes: DataFrame,
    mask: str = "mask",
    color: tuple[int, int, int] = (255, 0, 0),
    alpha: float = 0.4,
) -> DataFrame:
    """Adds ``overlay_r/g/b``: display gray with the mask blended in one colour."""
    _check_alpha(alpha)
    shown = normalize_for_display(planes)

    def channel(value: int) -> Column:
        return F.when(
            _same_size(mask, "mask"),
            F.zip_with(
                "display",
                mask,
                lambda g, m: F.when(
                    m, F.floor(F.least(g * F.lit(1.0 - alpha) + F.lit(alpha * value), F.lit(255.0)))
                )
                .otherwise(g)
                .cast("int"),
            ),
        )

    return shown.withColumns(
        {f"overlay_{n}": channel(v) for n, v in zip("rgb", color, strict=True)}
    )


def label_overlay(
    planes: DataFrame, labels: str = "labels", alpha: float = 0.5, background_label: int = 0
) -> DataFrame:
    """Adds ``overlay_r/g/b``: display gray blended with a cyclic colour per label.

    Background keeps its gray at the image weight ``1 - alpha`` plus the rest, i.e. unchanged.
    """
    _check_alpha(alpha)
    shown = normalize_for_display(planes)

    def channel(index: int) -> Column:
        palette = F.array(*[F.lit(c[index]) for c in LABEL_PALETTE])
        return F.when(
            _same_size(labels, "label"),
            F.zip_with(
                "display",
                labels,
                lambda g, n: F.when(n == background_label, g)
                .otherwise(
                    F.floor(
                        g * F.lit(1.0 - alpha)
                        + F.element_at(palette, (n % len(LABEL_PALETTE) + 1).cast("int")) * F.lit(alpha)
                    )
                )
                .cast("int"),
            ),
        )

    return shown.withColumns({f"overlay_{n}": channel(i) for i, n in enumerate("rgb")})


def pixel_calibration(size_x: Column, size_y: Column) -> Column:
    """``struct<resolution_x, resolution_y>`` = 1 / pixel size; null if either is missing."""
    positive = (size_x > 0) & (size_y > 0)
    return F.when(size_x.isNull() | size_y.isNull(), F.lit(None)).otherwise(
        F.when(
            positive, F.struct((1 / size_x).alias("resolution_x"), (1 / size_y).alias("resolution_y"))
        ).otherwise(F.raise_error(F.lit("pixel sizes must be positive")))
    )


def pixel_size(resolution: Column, unit: Column) -> Column:
    """Reverse calibration: known only when both a resolution and a unit are stored."""
    return F.when((resolution != 0) & unit.isNotNull(), 1 / resolution)


def calibrated_measurements(objects: DataFrame, calibration: DataFrame) -> DataFrame:
    """Add physical area and centroid from per-image ``pixel_size_x/y``.

    One equi-join on ``image_id``; uncalibrated images keep nulls.
    """
    joined = objects.join(
        calibration.select("image_id", "pixel_size_x", "pixel_size_y"), "image_id", "left"
    )
    return joined.withColumns(
        {
            "area_physical": F.col("area") * F.col("pixel_size_x") * F.col("pixel_size_y"),
            "centroid_0_physical": F.col("centroid_0") * F.col("pixel_size_y"),
            "centroid_1_physical": F.col("centroid_1") * F.col("pixel_size_x"),
        }
    )


def pixel_layers(intensity: DataFrame, *layers: DataFrame) -> DataFrame:
    """Bring plane arrays of several tables together, one plane row per image.

    The join key is the plane, so aligning masks and labels moves plane rows once instead
    of joining pixel by pixel; with tables bucketed on ``image_id`` it moves nothing.
    """
    joined = intensity
    for layer in layers:
        joined = joined.join(
            layer.select("image_id", *[c for c in layer.columns if c not in joined.columns]),
            "image_id",
        )
    return joined
