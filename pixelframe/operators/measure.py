"""Object measurements and stack projections."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.functions.names import resolve_method
from pixelframe.operators.regions import attach_intensity, label_objects
from pixelframe.sources.planes import explode_pixels

# Hyphenated column names expected by readers of exported measurement files.
EXPORT_NAMES = {
    "centroid_0": "centroid-0",
    "centroid_1": "centroid-1",
    "bbox_0": "bbox-0",
    "bbox_1": "bbox-1",
    "bbox_2": "bbox-2",
    "bbox_3": "bbox-3",
}


def measure_objects(labels: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """One row per object: area, centroid, half-open bounding box, optional intensities.

    ``labels`` is a labelled run table. Intensities come from ``v_sum``/``v_max`` carried by
    the runs, or from ``intensity`` planes. A single hash aggregation with map-side partials.
    """
    if intensity is not None:
        labels = attach_intensity(labels, intensity)
    length = (F.col("x1") - F.col("x0") + 1).cast("double")
    area = F.sum(length)
    columns = [
        area.alias("area"),
        (F.sum(length * F.col("y")) / area).alias("centroid_0"),
        (F.sum(length * (F.col("x0") + F.col("x1")) / 2) / area).alias("centroid_1"),
        F.min("y").alias("bbox_0"),
        F.min("x0").alias("bbox_1"),
        (F.max("y") + 1).alias("bbox_2"),
        (F.max("x1") + 1).alias("bbox_3"),
    ]
    if "v_sum" in labels.columns:
        columns += [
            (F.sum("v_sum") / area).alias("mean_intensity"),
            F.max("v_max").alias("max_intensity"),
        ]
    return labels.groupBy("image_id", "label").agg(*columns)


def measurements_from_mask(runs: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """Label 8-connected objects of a mask and measure them."""
    return measure_objects(label_objects(runs, 8), intensity)


def export_names(objects: DataFrame) -> DataFrame:
    return objects.withColumnsRenamed(EXPORT_NAMES)


def z_project(planes: DataFrame, method: str | None = "max") -> DataFrame:
    """Project every stack along depth, per time and channel: ``(stack_id, [t_index, c_index,] y, x, v)``.

    Times and channels count if the planes have them. Pixels of a stack stay spread over all its places; every
    method combines partial results before the shuffle; the median does so by counting (``middle_values``).
    """
    reducers = {"average": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "standard": F.stddev_pop}
    chosen = resolve_method(method)
    apart = [c for c in ("t_index", "c_index") if c in planes.columns]
    keys = ["stack_id", *apart, "y", "x"]
    pixels = explode_pixels(planes.select("stack_id", *apart, "width", "pixels")).select(*keys, "v")
    if chosen != "median":
        return pixels.groupBy(*keys).agg(reducers[chosen]("v").alias("v"))
    return middle_values(pixels, keys)


def middle_values(values: DataFrame, keys: Sequence[str], few: int = 1024) -> DataFrame:
    """Exact median ``v`` of the values of every group: the mean of the two middle ones if their number is even.

    Counts per group and value range tell the range that holds the middle, and only that range is counted again, so
    groups of any size are reduced by partial aggregation and nothing is sorted as a whole. The last ``few`` values of
    a group at most are gathered. Nulls do not count, NaN is the largest value, and groups of nulls are left out.
    """
    known = values.where(F.col("v").isNotNull()).select(*keys, "v")
    state = durable(
        known.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumns({"lower": F.expr("(n + 1) div 2"), "upper": F.expr("(n + 2) div 2")})
    )
    short, settled = [], []
    while True:
        short.append(state.where(F.col("n") <= few))
        long = state.where(F.col("n") > few)
        if long.isEmpty():
            break
        found = durable(_narrowed(known, long, keys))
        settled.append(found.where("done").select(*keys, "v"))
        state = found.where("NOT done").drop("done", "v")
    gathered = (
        _within(known, reduce(DataFrame.unionByName, short), keys)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("v")).alias("all"), F.min("lower").alias("lower"), F.min("upper").alias("upper"))
        .select(*keys, _between(F.get("all", F.col("lower") - 1), F.get("all", F.col("upper") - 1)).alias("v"))
    )
    return reduce(DataFrame.unionByName, settled, gathered)


def _between(a: Column, b: Column) -> Column:
    return F.when(F.col("lower") == F.col("upper"), a).otherwise((a + b) / 2)


def _within(known: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of the groups of ``state`` inside their range; keys may be null."""
    here = state.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return known.join(here, same).drop(*here.columns[: len(keys)]).where(F.col("v").between(F.col("lo"), F.col("hi")))


def _narrowed(known: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each group's part that holds the middle, or the median where that part is a single value (``done``).

    The range is cut into 64 parts. Its ends always fall into different ones, so every round leaves fewer values.
    """
    most = F.lit(sys.float_info.max)
    low, high = F.greatest(F.col("lo"), -most) / 2, F.least(F.col("hi"), most) / 2
    share = F.coalesce(F.try_divide(F.col("v") / 2 - low, high - low), F.lit(0.0))
    part = (
        F.when(F.col("v") <= F.col("lo"), 0)
        .when(F.col("v") >= F.col("hi"), 63)
        .otherwise(F.floor(F.least(F.greatest(share * 62, F.lit(0.0)), F.lit(62.0))))
    )
    counts = (
        _within(known, state, keys)
        .withColumn("part", part.cast("int"))
        .groupBy(*keys, "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
            F.min("lower").alias("lower"),
            F.min("upper").alias("upper"),
        )
    )
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # 64 parts at most
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))

    def holds(rank: str) -> Column:
        return (F.col("before") < F.col(rank)) & (F.col(rank) <= F.col("upto"))

    part_of = F.struct("part", "before", "n", "lo", "hi")
    middle = placed.groupBy(*keys).agg(
        F.max(F.when(holds("lower"), part_of)).alias("a"),
        F.max(F.when(holds("upper"), part_of)).alias("b"),
        F.min("lower").alias("lower"),
        F.min("upper").alias("upper"),
    )
    apart = F.col("a.part") != F.col("b.part")
    value = F.when(apart, _between(F.col("a.hi"), F.col("b.lo"))).otherwise(F.col("a.lo"))
    return middle.select(
        *keys,
        F.col("a.n").alias("n"),
        F.col("a.lo").alias("lo"),
        F.col("a.hi").alias("hi"),
        (F.col("lower") - F.col("a.before")).alias("lower"),
        (F.col("upper") - F.col("a.before")).alias("upper"),
        (apart | (F.col("a.lo") == F.col("a.hi"))).alias("done"),
        value.alias("v"),
    )


def zmax_intensity(planes: DataFrame) -> DataFrame:
    return z_project(planes, "max")
