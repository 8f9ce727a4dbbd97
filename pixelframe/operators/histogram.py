"""Per-image histograms and the Otsu threshold, inside the plane's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.arrays import bind

BINS = 256
#: Relative difference up to which two variances are equal; those of different splits of 64 pixels lie further apart.
TIED = 4e-15


def occupied_bins(
    pixels: Column, dtype: Column, bins: int = BINS, low: Column | None = None, high: Column | None = None
) -> Column:
    """``array<struct<bin, center, n>>`` of the occupied bins of a plane, ascending.

    ``low`` and ``high`` are the extremes of the whole plane where ``pixels`` are only a part of it.

    Integer planes have one bin per value; float planes have ``bins`` equal bins between their extremes. The
    pixels are sorted once, so every bin is a run of neighbours and its size the distance of two run ends.
    """
    integer = dtype.rlike("^u?int")

    def of(v: Column) -> Column:
        lo = F.get(v, F.lit(0)) if low is None else low
        hi = F.get(v, F.size(v) - 1) if high is None else high
        exact = integer | (lo == hi)
        width = (hi - lo) / bins
        shape = F.struct(
            lo.alias("lo"),
            (hi - lo).alias("span"),
            F.when(exact, lo).otherwise(lo + width / 2).alias("first"),
            F.when(exact, F.lit(1.0)).otherwise(width).alias("step"),
            F.when(integer, 2).when(lo == hi, 1).otherwise(0).alias("kind"),
        )
        return bind(shape, lambda s: bind(F.transform(v, lambda x: index(x, s)), lambda b: runs(b, s)))

    def index(x: Column, s: Column) -> Column:
        scaled = F.least(F.floor((x - s["lo"]) / s["span"] * bins), F.lit(bins - 1))
        return F.when(s["kind"] == 2, x - s["lo"]).when(s["kind"] == 1, F.lit(0)).otherwise(scaled).cast("bigint")

    def runs(b: Column, s: Column) -> Column:
        last = F.size(b) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(b, i) != F.get(b, i + 1)))

        def one(end: Column, k: Column, e: Column) -> Column:
            before = F.when(k > 0, F.get(e, k - 1)).otherwise(-1)
            bin_ = F.get(b, end)
            center = s["first"] + bin_ * s["step"]
            return F.struct(bin_.alias("bin"), center.alias("center"), (end - before).cast("bigint").alias("n"))

        return bind(ends, lambda e: F.transform(e, lambda end, k: one(end, k, e)))

    return F.when(F.size(pixels) > 0, bind(F.sort_array(pixels), of))


def intensity_histogram(planes: DataFrame, bins: int = BINS) -> DataFrame:
    """``(image_id, bin, center, n)`` for the occupied bins of every plane; narrow, only bins are exploded."""
    found = planes.select("image_id", F.explode(occupied_bins(F.col("pixels"), F.col("dtype"), bins)).alias("b"))
    return found.select("image_id", "b.*")


def best_bin(found: Column) -> Column:
    """Centre of the occupied bin with the largest between-class variance; the first of equal ones.

    Empty bins cannot improve the variance of the occupied bin before them, so only occupied bins are tried. A
    single bin returns its centre. Variances are taken from bin numbers and sizes, which are whole numbers: between
    splits that are equally good, rounded centres would leave the choice to the order in which pixels were summed.
    """

    def best(hist: Column) -> Column:
        whole = F.struct(
            F.aggregate(hist, F.lit(0).cast("bigint"), lambda t, x: t + x["n"]).alias("w"),
            F.aggregate(hist, F.lit(0.0), lambda t, x: t + x["n"] * x["bin"].cast("double")).alias("s"),
        )
        start = F.struct(
            F.lit(0).cast("bigint").alias("w1"),
            F.lit(0.0).alias("s1"),
            F.lit(float("-inf")).alias("variance"),
            F.lit(None).cast("double").alias("threshold"),
        )

        def step(state: Column, x: Column, all_: Column) -> Column:
            w1, s1 = state["w1"] + x["n"], state["s1"] + x["n"] * x["bin"].cast("double")
            gap = s1 * all_["w"] - all_["s"] * w1
            variance = F.coalesce(gap * gap / F.nullif(w1 * (all_["w"] - w1), F.lit(0)), F.lit(-1.0))
            better = variance > state["variance"] * (1 + TIED)
            return F.struct(
                w1.alias("w1"),
                s1.alias("s1"),
                F.when(better, variance).otherwise(state["variance"]).alias("variance"),
                F.when(better, x["center"]).otherwise(state["threshold"]).alias("threshold"),
            )

        return bind(whole, lambda a: F.aggregate(hist, start, lambda t, x: step(t, x, a), lambda t: t["threshold"]))

    return bind(found, best)


def otsu_of(pixels: Column, dtype: Column, bins: int = BINS) -> Column:
    """Otsu's threshold of a plane as one expression; a constant plane returns its value."""
    return best_bin(occupied_bins(pixels, dtype, bins))


def otsu_value(planes: DataFrame, bins: int = BINS) -> DataFrame:
    """``(image_id, threshold)`` of :func:`otsu_of` for every plane with pixels."""
    found = planes.select("image_id", otsu_of(F.col("pixels"), F.col("dtype"), bins).alias("threshold"))
    return found.where(F.col("threshold").isNotNull())


def otsu_threshold(planes: DataFrame, mask: str = "mask", bins: int = BINS) -> DataFrame:
    """Adds ``mask``: ``v > threshold`` (strict). Narrow: each plane finds its own threshold."""
    threshold = otsu_of(F.col("pixels"), F.col("dtype"), bins)
    return planes.withColumn(
        mask, bind(threshold, lambda t: F.transform(F.col("pixels"), lambda v: v > t))
    )
