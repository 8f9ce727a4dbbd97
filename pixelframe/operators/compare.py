"""Agreement between masks, measurement tables and projected planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.operators.regions import count_objects, mask_runs
from pixelframe.operators.stats import inspect_image

AREA_COLUMNS = ("area", "AreaShape_Area")


def _count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v)).cast("bigint")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(1.0)).otherwise(top / bottom)


def compare_masks(a: DataFrame, b: DataFrame, objects: bool = True) -> DataFrame:
    """IoU, Dice and pixel agreement per image, with object counts on request.

    The join moves one plane row per image; pixels are compared inside the joined row. An
    image present on one side only is not compared.
    """
    left = a.select("image_id", "height", "width", F.col("mask").alias("_a"))
    right = b.select(
        "image_id", F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("mask").alias("_b")
    )
    same = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    mismatch = F.raise_error(
        F.format_string(
            "mask shapes do not match: (%d, %d) vs (%d, %d)", "height", "width", "_h", "_w"
        )
    )
    counted = left.join(right, "image_id").select(
        "image_id",
        F.when(
            same,
            F.struct(
                _count(F.col("_a")).alias("fa"),
                _count(F.col("_b")).alias("fb"),
                _count(F.zip_with("_a", "_b", lambda x, y: x & y)).alias("both"),
                _count(F.zip_with("_a", "_b", lambda x, y: x | y)).alias("either"),
                _count(F.zip_with("_a", "_b", lambda x, y: x == y)).alias("equal"),
                F.size("_a").cast("bigint").alias("n"),
            ),
        )
        .otherwise(mismatch)
        .alias("s"),
    )
    result = counted.select(
        "image_id",
        _ratio(F.col("s.both"), F.col("s.either")).alias("iou"),
        _ratio(2 * F.col("s.both"), F.col("s.fa") + F.col("s.fb")).alias("dice"),
        _ratio(F.col("s.equal"), F.col("s.n")).alias("pixel_agreement"),
        F.col("s.fa").alias("foreground_pixels_a"),
        F.col("s.fb").alias("foreground_pixels_b"),
    )
    if not objects:
        return result
    for side, masked in (("a", a), ("b", b)):
        result = _with_count(result, count_objects(masked, mask_runs(masked)), side)
    return result


def _with_count(compared: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    return compared.join(counts.withColumnRenamed("object_count", f"object_count_{side}"), "image_id", "left")


def area_column(df: DataFrame) -> str | None:
    return next((c for c in AREA_COLUMNS if c in df.columns), None)


def compare_measurements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Object counts and mean areas of two measurement tables, per ``image_id``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        column = area_column(df)
        area = F.avg(column) if column else F.lit(None).cast("double")
        return df.groupBy("image_id").agg(
            F.count(F.lit(1)).alias(f"object_count_{name}"), area.alias(f"mean_area_{name}")
        )

    joined = side(a, "a").join(side(b, "b"), "image_id", "full")
    na, nb = (
        F.coalesce(f"object_count_{s}", F.lit(0).cast("bigint")) for s in ("a", "b")
    )
    return joined.select(
        "image_id",
        na.alias("object_count_a"),
        nb.alias("object_count_b"),
        (na - nb).alias("count_difference"),
        F.when(nb != 0, na / nb).alias("count_ratio"),
        "mean_area_a",
        "mean_area_b",
        (F.col("mean_area_a") - F.col("mean_area_b")).alias("mean_area_difference"),
        F.lit(area_column(a)).cast("string").alias("area_column_a"),
        F.lit(area_column(b)).cast("string").alias("area_column_b"),
    )


def compare_projected(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Ranges, non-zero counts and absolute differences of two projections per image.

    Differences stay null when the shapes differ.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            "image_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("height", "width", "dtype", "pixels")]
        )

    r, c = F.col("r_pixels"), F.col("c_pixels")
    same = (F.col("r_height") == F.col("c_height")) & (F.col("r_width") == F.col("c_width"))
    diff = F.when(same, F.zip_with("r_pixels", "c_pixels", lambda x, y: F.abs(y - x)))
    nonzero = lambda p: _count(F.transform(p, lambda v: v != 0))
    joined = side(reference, "r").join(side(candidate, "c"), "image_id").withColumn("_d", diff)
    size = F.size("_d")
    return joined.select(
        "image_id",
        F.coalesce(F.array_min(r), F.lit(0.0)).alias("reference_min"),
        F.coalesce(F.array_min(c), F.lit(0.0)).alias("candidate_min"),
        F.coalesce(F.array_max(r), F.lit(0.0)).alias("reference_max"),
        F.coalesce(F.array_max(c), F.lit(0.0)).alias("candidate_max"),
        nonzero(r).alias("reference_nonzero"),
        nonzero(c).alias("candidate_nonzero"),
        F.when(same, F.coalesce(F.array_max("_d"), F.lit(0.0))).alias("max_abs_diff"),
        F.when(
            same,
            F.when(size == 0, F.lit(0.0)).otherwise(
                F.aggregate("_d", F.lit(0.0), lambda acc, v: acc + v) / size
            ),
        ).alias("mean_abs_diff"),
        (same & (r == c)).alias("identical"),
    )


def validation_report(
    planes: DataFrame,
    mask: DataFrame | None = None,
    reference_mask: DataFrame | None = None,
    measurements: DataFrame | None = None,
    reference_measurements: DataFrame | None = None,
    external_measurements: DataFrame | None = None,
) -> DataFrame:
    """One nested row per image: properties and every comparison whose inputs are given.

    Measurements missing for a given mask are computed from that mask; its objects are then labelled once, for them and
    for the object counts.
    """
    from pixelframe.operators.measure import measure_objects
    from pixelframe.operators.regions import label_objects

    def measured(masked: DataFrame) -> DataFrame:
        pixels = planes.select("image_id", "pixels")
        with_pixels = masked.drop("pixels").join(pixels, "image_id")
        return durable(measure_objects(label_objects(mask_runs(with_pixels, intensity="pixels"))))

    def counted(masked: DataFrame, objects: DataFrame | None) -> DataFrame:
        if objects is None:
            return count_objects(masked, mask_runs(masked))
        found = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("object_count"))
        return masked.select("image_id").join(found, "image_id", "left").fillna(0, "object_count")

    own = measured(mask) if measurements is None and mask is not None else None
    own_reference = measured(reference_mask) if reference_measurements is None and reference_mask is not None else None
    measurements = own if measurements is None else measurements
    reference_measurements = own_reference if reference_measurements is None else reference_measurements

    inspected = inspect_image(planes)
    properties = F.struct(*[c for c in inspected.columns if c != "image_id"])
    report = inspected.select("image_id", properties.alias("image_properties"))

    def attach(df: DataFrame, part: DataFrame | None, name: str) -> DataFrame:
        if part is None:
            return df.withColumn(name, F.lit(None).cast("string"))
        nested = F.struct(*[c for c in part.columns if c != "image_id"]).alias(name)
        return df.join(part.select("image_id", nested), "image_id", "left")

    masks = None
    if mask is not None and reference_mask is not None:
        masks = compare_masks(mask, reference_mask, objects=False)
        masks = _with_count(masks, counted(mask, own), "a")
        masks = _with_count(masks, counted(reference_mask, own_reference), "b")
    both = measurements is not None and reference_measurements is not None
    outside = measurements is not None and external_measurements is not None
    report = attach(report, masks, "mask_comparison")
    report = attach(
        report,
        compare_measurements(measurements, reference_measurements) if both else None,
        "measurement_comparison",
    )
    return attach(
        report,
        compare_measurements(measurements, external_measurements) if outside else None,
        "external_measurement_comparison",
    )
