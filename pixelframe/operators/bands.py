"""Planes larger than a row: bands of image lines with halos.

A plane is stored as rows ``(image_id, …, plane_height, width, dtype, band_lines, band, y0, height, pixels)``. A band
holds the lines ``y0 .. y0 + height - 1`` of its plane, ``band_lines`` of them but for the last one. Within a band
``height`` and ``width`` mean what they mean in a plane, so pixel-wise operators work on bands as they are.

Stencils need lines of the neighbours: only those edge lines are exchanged, one row per pair of neighbouring bands. A
halo ends where the plane ends, so the border rule of any stencil holds there without being named, and what it makes
up at a cut lies in the lines that are cropped. Runs are numbered by the lines of the plane, hence labels cross seams
like any other lines. No row ever holds more than a band and its halo.

Empty tables give empty results; null pixels are treated as the operator in question treats them on whole planes.
``image_id`` must not be null, and every array column must describe the pixels of its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.functions.arrays import as_column, bind
from pixelframe.operators import stencil
from pixelframe.operators.histogram import BINS, best_bin, occupied_bins
from pixelframe.operators.measure import measure_objects
from pixelframe.operators.regions import label_objects, mask_runs, paint_runs, remove_small_objects

BAND_LINES = 512
BAND_KEY = ["image_id", "band"]


def plane_arrays(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def cut_bands(planes: DataFrame, lines: int = BAND_LINES) -> DataFrame:
    """Plane rows → band rows; narrow. Planes without lines have no bands."""
    _check_lines(lines)
    arrays = plane_arrays(planes)
    rest = [c for c in planes.columns if c not in (*arrays, "height")]
    y0 = F.col("band") * lines
    count = F.least(F.lit(lines), F.col("plane_height") - y0)
    return (
        planes.filter(F.col("height") > 0)
        .withColumnRenamed("height", "plane_height")
        .withColumn("band_lines", F.lit(lines))
        .withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((F.col("plane_height") - 1) / lines).cast("int"))))
        .select(
            *rest,
            "plane_height",
            "band_lines",
            "band",
            y0.alias("y0"),
            count.alias("height"),
            *[F.slice(a, y0 * F.col("width") + 1, count * F.col("width")).alias(a) for a in arrays],
        )
    )


def bands_from_lines(lines: DataFrame, heights: DataFrame, band_lines: int = BAND_LINES, dtype: str = "float64") -> DataFrame:
    """Bands from image lines ``(image_id, y, line)`` and ``heights`` ``(image_id, plane_height)``.

    One shuffle by (image, band); a plane is never gathered. All lines of a plane must be there and equally long.
    """
    _check_lines(band_lines)
    numbered = lines.select(
        "image_id", F.floor(F.col("y") / band_lines).cast("int").alias("band"), F.struct(F.col("y").cast("int").alias("y"), "line").alias("_l")
    )
    gathered = numbered.groupBy(*BAND_KEY).agg(F.array_sort(F.collect_list("_l")).alias("_l"))
    return gathered.join(heights.select("image_id", F.col("plane_height").cast("int").alias("plane_height")), "image_id").select(
        "image_id",
        "plane_height",
        F.size(F.get("_l", F.lit(0))["line"]).alias("width"),
        F.lit(dtype).alias("dtype"),
        F.lit(band_lines).alias("band_lines"),
        "band",
        (F.col("band") * band_lines).alias("y0"),
        F.size("_l").alias("height"),
        F.flatten(F.col("_l")["line"]).cast("array<double>").alias("pixels"),
    )


def _check_lines(lines: int) -> None:
    if lines < 1:
        raise ValueError("a band needs at least one line")


def write_banded_planes(bands: DataFrame, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """Store bands bucketed by image and band: stencils then exchange halo lines only, never whole bands."""
    bands.write.mode(mode).bucketBy(buckets, *BAND_KEY).sortBy(*BAND_KEY).saveAsTable(table)


def _halo_lines(bands: DataFrame, arrays: list[str], reach: Column) -> DataFrame:
    """``(image_id, band, _halo)``: the lines that other bands hold within ``reach`` of a band, in order."""
    lines, y0, width = F.col("band_lines"), F.col("y0"), F.col("width")
    end = y0 + F.col("height")
    first = F.greatest(F.floor((y0 - reach) / lines), F.lit(0))
    last = F.least(F.floor((end - 1 + reach) / lines), F.floor((F.col("plane_height") - 1) / lines))
    targets = F.filter(F.sequence(first.cast("int"), last.cast("int")), lambda t: t != F.col("band"))
    sent = bands.withColumn("_reach", reach).withColumn("_to", F.explode(targets))
    low = F.greatest(y0, F.col("_to") * lines - F.col("_reach"))
    high = F.least(end, (F.col("_to") + 1) * lines + F.col("_reach"))
    inside = F.filter(
        F.array(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))), lambda s: s["low"] < s["high"]
    )
    pieces = sent.withColumn("_s", F.explode(inside)).select(
        "image_id",
        F.col("_to").alias("band"),
        F.struct(
            F.col("_s.low").alias("low"),
            (F.col("_s.high") - F.col("_s.low")).alias("lines"),
            *[
                F.slice(a, (F.col("_s.low") - y0) * width + 1, (F.col("_s.high") - F.col("_s.low")) * width).alias(a)
                for a in arrays
            ],
        ).alias("_piece"),
    )
    order = lambda a, b: a["low"] - b["low"]
    return pieces.groupBy(*BAND_KEY).agg(F.array_sort(F.collect_list("_piece"), order).alias("_halo"))


def with_halo(bands: DataFrame, reach: int | Column) -> DataFrame:
    """Bands with up to ``reach`` lines of their plane above and below, and ``_top``: how many are above.

    A wide reach takes lines of several bands. The neighbours' lines of a band arrive together: at most ``2 * reach``.
    """
    arrays = plane_arrays(bands)
    reach = as_column(reach).cast("int")
    halo = _halo_lines(bands, arrays, reach)
    joined = bands.join(halo, BAND_KEY, "left")
    kind = halo.schema["_halo"].dataType
    pieces = F.coalesce("_halo", F.array().cast(kind))
    above = F.filter(pieces, lambda p: p["low"] < F.col("y0"))
    below = F.filter(pieces, lambda p: p["low"] > F.col("y0"))

    def count(side: Column) -> Column:
        return F.aggregate(side, F.lit(0), lambda n, p: n + p["lines"])

    # One element per row: what follows reads finished arrays instead of composing them again for every pixel.
    grown = F.struct(
        (count(above) + F.col("height") + count(below)).alias("height"),
        count(above).alias("_top"),
        F.col("height").alias("_own"),
        *[F.concat(F.flatten(F.transform(above, lambda p: p[a])), F.col(a), F.flatten(F.transform(below, lambda p: p[a]))).alias(a) for a in arrays],
    )
    rest = [c for c in bands.columns if c not in (*arrays, "height")]
    return joined.select(*rest, F.explode(F.array(grown)).alias("_g")).select(*rest, "_g.*")


def by_bands(bands: DataFrame, reach: int | Column, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator on planes that looks at most ``reach`` lines up and down to bands with halos, and crop.

    ``work`` keeps the rows and ``height`` and ``width`` of what it gets; its array columns describe pixels.
    """
    done = work(with_halo(bands, reach))
    arrays = plane_arrays(done)
    start = F.col("_top") * F.col("width") + 1
    cropped = {a: F.slice(a, start, F.col("_own") * F.col("width")) for a in arrays}
    return done.withColumns({**cropped, "height": F.col("_own")}).drop("_top", "_own")


# Stencils ----------------------------------------------------------------------------------


def gaussian_blur(bands: DataFrame, sigma: float = 1.0, integer_output: bool | None = None) -> DataFrame:
    return by_bands(bands, int(4 * sigma + 0.5), lambda p: stencil.gaussian_blur(p, sigma, integer_output))


def median_filter(bands: DataFrame, radius: int = 1) -> DataFrame:
    return by_bands(bands, radius, lambda p: stencil.median_filter(p, radius))


def rolling_ball_subtract(bands: DataFrame, radius: int | None = None) -> DataFrame:
    """An opening looks twice as far as its disk. Without a radius the size of the whole plane decides."""
    side = F.least("plane_height", "width")
    disk = F.greatest(F.lit(8), F.floor(side / 8)).cast("int") if radius is None else F.lit(radius)
    return by_bands(bands, 2 * disk, lambda p: stencil.rolling_ball_subtract(p, disk))


def binary_opening(bands: DataFrame, mask: str = "mask") -> DataFrame:
    return by_bands(bands, 2, lambda p: stencil.binary_opening(p, mask))


def adaptive_threshold(bands: DataFrame, block_size: int = 51, offset: float = 0.0) -> DataFrame:
    reach = int(4 * ((block_size - 1) / 6.0) + 0.5)
    return by_bands(bands, reach, lambda p: stencil.adaptive_threshold(p, block_size, offset))


def sauvola_threshold(bands: DataFrame, block_size: int = 51, k: float = 0.2, r: float | None = None) -> DataFrame:
    """Without ``r`` the largest value of the whole plane is the range: one value per plane, aggregated before it moves."""
    if r is not None:
        return by_bands(bands, block_size // 2, lambda p: stencil.sauvola_threshold(p, block_size, k, r))
    largest = bands.groupBy("image_id").agg(F.max(F.array_max("pixels")).alias("_largest"))
    with_range = bands.join(largest, "image_id")
    return by_bands(
        with_range, block_size // 2, lambda p: stencil.sauvola_threshold(p, block_size, k, F.col("_largest"))
    ).drop("_largest")


def integral_image(bands: DataFrame, name: str = "integral") -> DataFrame:
    """Inclusive prefix sums of the whole plane: sums inside every band, plus what the bands above it hold.

    Only last lines are shuffled, one value per band and column; a window holds one column's bands.
    """
    own = stencil.integral_image(bands, name)
    bottom = own.select(
        *BAND_KEY, F.posexplode(F.slice(name, (F.col("height") - 1) * F.col("width") + 1, F.col("width"))).alias("x", "s")
    )
    above = Window.partitionBy("image_id", "x").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        bottom.withColumn("s", F.coalesce(F.sum("s").over(above), F.lit(0.0)))
        .groupBy(*BAND_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("x", "s")))["s"].alias("_above"))
    )
    summed = F.transform(name, lambda v, i: v + F.get("_above", (i % F.col("width")).cast("int")))
    return own.join(carried, BAND_KEY).withColumn(name, summed).drop("_above")


# Thresholds, runs and objects --------------------------------------------------------------


def intensity_histogram(bands: DataFrame, bins: int = BINS) -> DataFrame:
    """``(image_id, bin, center, n)`` of whole planes: extremes first, then counts per band, added up by bin."""
    extremes = bands.groupBy("image_id").agg(
        F.min(F.array_min("pixels")).alias("_lo"), F.max(F.array_max("pixels")).alias("_hi")
    )
    found = occupied_bins(F.col("pixels"), F.col("dtype"), bins, F.col("_lo"), F.col("_hi"))
    return (
        bands.select("image_id", "dtype", "pixels")
        .join(extremes, "image_id")
        .select("image_id", F.explode(found).alias("b"))
        .groupBy("image_id", "b.bin")
        .agg(F.min("b.center").alias("center"), F.sum("b.n").alias("n"))
    )


def otsu_value(bands: DataFrame, bins: int = BINS) -> DataFrame:
    """``(image_id, threshold)``; at most ``bins`` bins of a float plane meet in a row, of an integer plane its values."""
    whole = intensity_histogram(bands, bins).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "center", "n"))).alias("_bins")
    )
    return whole.select("image_id", best_bin(F.col("_bins")).alias("threshold"))


def otsu_threshold(bands: DataFrame, mask: str = "mask", bins: int = BINS) -> DataFrame:
    """Adds ``mask``: ``v > threshold`` of the whole plane."""
    found = otsu_value(bands, bins).withColumnRenamed("threshold", "_t")
    return bands.join(found, "image_id").withColumn(mask, F.transform("pixels", lambda v: v > F.col("_t"))).drop("_t")


def band_runs(bands: DataFrame, mask: str = "mask", intensity: str | None = None) -> DataFrame:
    """Runs of whole planes (lines and height are the plane's), as every operator on runs takes them; narrow."""
    place = F.struct("image_id", "y0", "plane_height")
    runs = mask_runs(bands.withColumn("image_id", place), mask, intensity)
    return runs.select(
        "image_id.image_id",
        F.col("image_id.plane_height").alias("height"),
        "width",
        (F.col("y") + F.col("image_id.y0")).alias("y"),
        *[c for c in runs.columns if c not in ("image_id", "height", "width", "y")],
    )


def paint_labels(bands: DataFrame, labels: DataFrame, name: str = "labels") -> DataFrame:
    """Add the array ``name`` with the label of every pixel, 0 outside; a row takes the runs of its own lines."""
    cut = bands.groupBy("image_id").agg(F.first("band_lines").alias("_n"))
    line = F.col("y") % F.col("_n")
    run = F.struct(
        (line * F.col("width") + F.col("x0")).alias("start"), (line * F.col("width") + F.col("x1")).alias("stop"), "label"
    )
    grouped = (
        labels.join(cut, "image_id")
        .groupBy("image_id", F.floor(F.col("y") / F.col("_n")).cast("int").alias("band"))
        .agg(F.sort_array(F.collect_list(run)).alias("_runs"))
    )
    painted = bind(
        F.coalesce("_runs", F.array().cast(grouped.schema["_runs"].dataType)),
        lambda r: paint_runs(
            r,
            F.col("height") * F.col("width"),
            lambda one: F.array_repeat(one["label"], (one["stop"] - one["start"] + 1).cast("int")),
            F.lit(0),
        ),
    )
    return bands.join(grouped, BAND_KEY, "left").withColumn(name, painted).drop("_runs")


def segment_bands(bands: DataFrame, blur_sigma: float = 1.0, min_object_size: int = 20) -> DataFrame:
    """The default chain on banded planes: blur → Otsu → drop small objects → label → measure the original pixels."""
    blurred = gaussian_blur(bands.withColumn("raw_pixels", F.col("pixels")), blur_sigma)
    runs = band_runs(otsu_threshold(blurred), intensity="raw_pixels")
    return measure_objects(label_objects(remove_small_objects(runs, min_object_size)))
