"""Self-adaptive segmentation: every image picks its own correction and threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.functions.arrays import bind
from pixelframe.operators.histogram import otsu_of, otsu_threshold
from pixelframe.operators.pixelwise import normalize_robust
from pixelframe.operators.regions import (
    fill_holes,
    label_objects,
    mask_runs,
    remove_small_per_image,
    runs_to_mask,
    should_split,
)
from pixelframe.operators.stats import (
    choose_method,
    estimate_block_size,
    foreground_fraction,
    min_size_expr,
    offset_expr,
    sanity_warning,
    score_confidence,
    vignette_expr,
    with_inspection,
)
from pixelframe.operators.stencil import (
    background_opening,
    binary_opening,
    convolve_separable,
    default_ball_radius,
    fixed_weights,
    local_threshold_mask,
    sauvola_mask,
)
from pixelframe.operators.watershed import split_touching
from pixelframe.plans.pipeline import split_valid

# Texts of the decision record.
FELL_BACK = "Fell back to %s threshold."
USED_OTSU = "Used Otsu fallback after sanity checks failed."
RECOVERED = "Recovered empty mask using Otsu after morphology."

METHODS = ["otsu", "local", "sauvola"]


@dataclass
class AdaptiveResult:
    decisions: DataFrame
    mask: DataFrame
    labels: DataFrame
    corrected: DataFrame
    failed: DataFrame


def _corrected(planes: DataFrame) -> DataFrame:
    """Background subtraction for shaded or weak images, blur for very weak ones."""
    rated = with_inspection(planes.withColumn("vignette_score", vignette_expr())).select(
        *planes.columns, "vignette_score", "estimated_snr", "limitations"
    )
    snr = F.col("estimated_snr")
    use_ball = (F.col("vignette_score") >= 0.05) | F.coalesce(snr < 6.0, F.lit(False))
    flattened = bind(
        background_opening(F.col("pixels"), default_ball_radius()),
        lambda bg: F.zip_with("pixels", bg, lambda v, b: F.greatest(v - b, F.lit(0.0))),
    )
    ball = rated.withColumns(
        {
            "pixels": F.when(use_ball, flattened).otherwise(F.col("pixels")),
            "ball_radius": default_ball_radius(),
            "blur_sigma": F.when(snr < 4.0, 1.0).otherwise(0.0),
        }
    )
    blurred = convolve_separable(F.col("pixels"), fixed_weights(1.0))
    return ball.withColumns(
        {
            "pixels": F.when(F.col("blur_sigma") > 0, blurred).otherwise(F.col("pixels")),
            "dtype": F.lit("float32"),
        }
    )


def _candidate(method: str, otsu: Column) -> Column:
    """Mask of one method on the normalised plane."""
    pixels = F.col("pixels")
    if method == "otsu":
        return F.transform(pixels, lambda v: v > otsu)
    if method == "sauvola":
        scaled = F.transform(pixels, lambda v: v * 255.0)
        peak = F.array_max(pixels) * 255.0
        limit = F.when(peak > 0, peak).otherwise(255.0)
        return bind(
            F.struct(scaled.alias("p"), limit.alias("r")),
            lambda s: sauvola_mask(s["p"], F.col("block_size"), 0.2, s["r"]),
        )
    return local_threshold_mask(pixels, F.col("block_size"), F.least("offset", F.lit(0.05)))


def _pick_mask(ready: DataFrame) -> DataFrame:
    """Primary mask when plausible, else the first plausible of otsu, local, sauvola.

    The fallbacks sit in CASE branches: an image whose primary mask is plausible never
    evaluates them.
    """
    primary = F.coalesce(
        *[F.when(F.col("primary") == m, _candidate(m, F.col("otsu"))) for m in METHODS]
    )
    tried = ready.withColumn("mask", primary).withColumn(
        "primary_warning", sanity_warning(foreground_fraction(F.col("mask")))
    )

    def entry(method: str) -> Column:
        return bind(
            _candidate(method, F.col("otsu")),
            lambda m: F.when(
                sanity_warning(foreground_fraction(m)).isNull(),
                F.struct(F.lit(method).alias("method"), m.alias("mask"), F.lit(True).alias("sane")),
            ),
        )

    last = bind(
        _candidate("otsu", F.col("otsu")),
        lambda m: F.when(
            F.exists(m, lambda v: v),
            F.struct(F.lit("otsu").alias("method"), m.alias("mask"), F.lit(False).alias("sane")),
        ),
    )
    fallback = F.when(
        F.col("primary_warning").isNotNull(),
        F.coalesce(*[F.when(F.col("primary") != m, entry(m)) for m in METHODS], last),
    )
    chosen = tried.withColumn("fallback", fallback)
    return chosen.withColumns(
        {
            "method": F.coalesce("fallback.method", "primary"),
            "mask": F.coalesce("fallback.mask", "mask"),
            "fallback_used": F.col("fallback").isNotNull(),
            "warnings": F.concat(
                "limitations",
                F.array_compact(
                    F.array(
                        F.col("primary_warning"),
                        F.when(F.col("fallback.sane"), F.format_string(FELL_BACK, "fallback.method")),
                        F.when(~F.col("fallback.sane"), F.lit(USED_OTSU)),
                    )
                ),
            ),
        }
    ).drop("fallback", "primary_warning")


def adaptive_segment(
    planes: DataFrame,
    min_object_size: int = 20,
    min_distance: int = 8,
    min_peak_ratio: float = 0.5,
) -> AdaptiveResult:
    """Whole adaptive decision for all images at once, one decision row per image.

    Corrected planes are kept in a reliable checkpoint: the background opening costs far more
    than writing its result, and several later branches read it.
    """
    good, failed = split_valid(planes)
    base = ["image_id", "height", "width", "dtype", "pixels"]
    corrected = durable(_corrected(good.select(*base)))

    blocks = estimate_block_size(otsu_threshold(corrected)).drop("mask")
    tuned = blocks.withColumns(
        {
            "offset": offset_expr(),
            "min_size": min_size_expr(F.col("block_size"), min_object_size),
            "primary": choose_method(F.col("estimated_snr"), F.col("vignette_score")),
        }
    )
    normal = normalize_robust(tuned).withColumn("otsu", otsu_of(F.col("pixels"), F.col("dtype")))
    chosen = durable(_pick_mask(normal))

    sizes = chosen.select("image_id", "min_size")
    opened = binary_opening(chosen)
    cleaned = durable(remove_small_per_image(fill_holes(mask_runs(opened)), sizes))
    lost = chosen.filter(F.col("method") != "otsu").join(
        cleaned.select("image_id").distinct(), "image_id", "left_anti"
    )
    recovered = lost.withColumn("mask", _candidate("otsu", F.col("otsu")))
    rescued = remove_small_per_image(fill_holes(mask_runs(recovered)), sizes)
    columns = ["image_id", "height", "width", "y", "x0", "x1"]
    runs = durable(cleaned.select(*columns).unionByName(rescued.select(*columns)))

    frames = chosen.select("image_id", "height", "width")
    split = durable(should_split(frames, runs))
    touching = frames.join(split.filter("split").select("image_id"), "image_id", "left_semi")
    parted = split_touching(runs_to_mask(touching, runs), min_distance, min_peak_ratio)
    whole = label_objects(
        runs.join(split.filter("not split").select("image_id"), "image_id", "left_semi")
    )
    labels = durable(
        parted.select(*columns, "label").unionByName(whole.select(*columns, "label"))
    )

    area = runs.groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_area"))
    objects = labels.groupBy("image_id").agg(F.max("label").alias("_objects"))
    flags = lost.select("image_id", F.lit(True).alias("_lost"))
    was_lost = F.coalesce("_lost", F.lit(False))
    decided = (
        chosen.join(flags, "image_id", "left")
        .join(split.select("image_id", "split"), "image_id", "left")
        .join(area, "image_id", "left")
        .join(objects, "image_id", "left")
        .withColumns(
            {
                "method": F.when(was_lost, "otsu").otherwise(F.col("method")),
                "fallback_used": F.col("fallback_used") | was_lost,
                "warnings": F.when(was_lost, F.array_append("warnings", F.lit(RECOVERED))).otherwise(
                    F.col("warnings")
                ),
                "object_count": F.coalesce("_objects", F.lit(0)),
            }
        )
    )
    decisions = decided.select(
        "image_id",
        "method",
        "block_size",
        "offset",
        "ball_radius",
        "blur_sigma",
        "estimated_snr",
        "vignette_score",
        F.col("split").alias("split_touching"),
        score_confidence(
            F.col("estimated_snr"), F.col("warnings"), F.col("fallback_used"), F.col("object_count")
        ).alias("confidence"),
        (F.coalesce("_area", F.lit(0)) / (F.col("height") * F.col("width"))).alias(
            "foreground_fraction"
        ),
        "object_count",
        "warnings",
        "fallback_used",
    )
    return AdaptiveResult(decisions, runs, labels, corrected, failed)


def adaptive_batch(planes: DataFrame, **parameters) -> dict[str, DataFrame]:
    """Adaptive segmentation of a whole collection with its summary tables."""
    result = adaptive_segment(planes, **parameters)
    return {
        "decisions": result.decisions,
        "processed": result.decisions.select("image_id"),
        "failed": result.failed.select("image_id", "error"),
        "mask": result.mask,
        "labels": result.labels,
    }
