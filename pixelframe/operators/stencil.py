"""Neighbourhood filters on planes (blur, median, background, local thresholds).

A plane is one row, so each filter is a narrow projection: no shuffle and no exploded
neighbour rows. Windows are taken with ``slice`` on border-padded scanlines; separable
filters run as a vertical pass followed by a horizontal pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.arrays import (
    as_column,
    bind,
    border_table,
    height,
    mirror_index,
    padded_rows,
    per_pixel,
    positions,
    power_of_two,
    total,
    width,
)



def _check_radius(name: str, value: float) -> None:
    if value < 0:
        raise ValueError(f"{name} must be greater than or equal to 0")


def _check_block(block_size: int) -> None:
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    if block_size % 2 == 0:
        raise ValueError("block_size must be odd")


def gaussian_weights(sigma: Column) -> Column:
    """Normalised kernel truncated at four standard deviations; ``[1]`` for sigma 0."""
    radius = F.floor(4 * sigma + 0.5).cast("int")
    raw = F.transform(
        F.sequence(-radius, radius), lambda k: F.exp(-0.5 * k * k / (sigma * sigma))
    )
    scaled = bind(
        raw,
        lambda w: bind(
            F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v),
            lambda s: F.transform(w, lambda v: v / s),
        ),
    )
    return F.when(sigma > 0, scaled).otherwise(F.array(F.lit(1.0)))


def fixed_weights(sigma: float) -> list[float]:
    """The same kernel for a sigma known when the query is written."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _weighted(weights: Column | list[float], value_at) -> Column:
    if isinstance(weights, list):  # unrolled: one flat expression per pixel, no inner lambda
        return reduce(
            lambda acc, k: acc + F.lit(weights[k]) * value_at(F.lit(k)),
            range(len(weights)),
            F.lit(0.0),
        )
    return F.aggregate(
        positions(F.size(weights)), F.lit(0.0), lambda acc, k: acc + F.get(weights, k) * value_at(k)
    )


def convolve_separable(
    pixels: Column, weights: Column | list[float], truncate: Column | None = None
) -> Column:
    """Apply a symmetric 1-D kernel down the columns, then along the rows."""

    def settle(value: Column) -> Column:
        if truncate is None:
            return value
        return F.when(truncate, value.cast("bigint").cast("double")).otherwise(value)

    def vertical(p: Column, w: Column | list[float], radius: Column) -> Column:
        return bind(
            border_table(radius, height()),
            lambda rows: per_pixel(
                height(), width(), lambda y, x: settle(_weighted(w, lambda k: F.get(p, F.get(rows, y + k) * width() + x)))
            ),
        )

    def horizontal(p: Column, w: Column | list[float], radius: Column) -> Column:
        return bind(
            border_table(radius, width()),
            lambda cols: per_pixel(
                height(), width(), lambda y, x: settle(_weighted(w, lambda k: F.get(p, y * width() + F.get(cols, x + k))))
            ),
        )

    def both(w: Column | list[float]) -> Column:
        radius = (
            F.lit(len(w) // 2) if isinstance(w, list) else ((F.size(w) - 1) / 2).cast("int")
        )
        return bind(
            pixels, lambda p: bind(vertical(p, w, radius), lambda q: horizontal(q, w, radius))
        )

    return both(weights) if isinstance(weights, list) else bind(weights, both)


def gaussian_blur(
    planes: DataFrame, sigma: float | Column = 1.0, integer_output: bool | None = None
) -> DataFrame:
    """Gaussian blur. Integer planes stay integer (each pass truncates) unless told otherwise."""
    if not isinstance(sigma, Column):
        _check_radius("sigma", sigma)
        if sigma == 0:
            return planes
    if integer_output is None:
        truncate = F.col("dtype").rlike("^u?int")
    else:
        truncate = F.lit(True) if integer_output else None
    if isinstance(sigma, Column):
        weights: Column | list[float] = gaussian_weights(sigma.cast("double"))
    else:
        weights = _kernel(float(sigma))
    return planes.withColumn("pixels", convolve_separable(F.col("pixels"), weights, truncate))


def _kernel(sigma: float) -> Column | list[float]:
    """Weights of one formula for every sigma, summed in one order; long kernels are not unrolled."""
    weights = fixed_weights(sigma)
    return weights if len(weights) <= 33 else F.array(*[F.lit(w) for w in weights])


def median_filter(planes: DataFrame, radius: int = 1) -> DataFrame:
    """Median of the (2r+1)×(2r+1) window, reflected at the border."""
    _check_radius("radius", radius)
    if radius == 0:
        return planes
    size = 2 * radius + 1

    def window(rows: Column, ys: Column, y: Column, x: Column) -> Column:
        return F.flatten(
            F.transform(
                F.slice(ys, y + 1, size), lambda sy: F.slice(F.get(rows, sy), x + 1, size)
            )
        )

    filtered = bind(
        F.col("pixels"),
        lambda p: bind(
            padded_rows(p, height(), width(), radius),
            lambda rows: bind(
                border_table(radius, height()),
                lambda ys: per_pixel(
                    height(),
                    width(),
                    lambda y, x: F.get(
                        F.sort_array(window(rows, ys, y, x)), F.lit((size * size) // 2)
                    ),
                ),
            ),
        ),
    )
    return planes.withColumn("pixels", filtered)


def _doubled(rows: Column, reach: Column, pick: Callable[..., Column]) -> Column:
    """Sparse tables of lines: entry ``k`` of a line holds the extreme of ``2 ** k`` pixels from every place on, up to
    windows of ``reach`` pixels. A window of any length is covered by two that overlap."""
    levels = F.floor(F.log2(reach.cast("double"))).cast("int")

    def table(row: Column) -> Column:
        return F.aggregate(
            positions(levels),
            F.array(row),
            lambda done, k: F.concat(
                done,
                F.array(
                    bind(
                        F.get(done, k),
                        lambda last: F.transform(last, lambda v, i: pick(v, F.get(last, i + power_of_two(k)))),
                    )
                ),
            ),
        )

    return F.transform(rows, table)


def _disk_extreme(pixels: Column, radius: Column, pick: Callable[..., Column], of_all: Callable[[Column], Column]) -> Column:
    """Minimum or maximum over a disk: two look-ups for each of its lines, whatever their length."""

    def body(tables: Column, ys: Column, spans: Column) -> Column:
        def at(y: Column, x: Column) -> Column:
            def line(span: Column, d: Column) -> Column:
                values = F.get(F.get(tables, F.get(ys, y + d)), span["level"])
                return pick(F.get(values, x + span["first"]), F.get(values, x + span["second"]))

            return of_all(F.transform(spans, line))

        return per_pixel(height(), width(), at)

    half = F.transform(
        F.sequence(-radius, radius), lambda d: F.floor(F.sqrt(radius * radius - d * d)).cast("int")
    )

    def span(h: Column) -> Column:
        level = F.floor(F.log2((2 * h + 1).cast("double"))).cast("int")
        last = radius + h + 1 - power_of_two(level)
        return F.struct(level.alias("level"), (radius - h).alias("first"), last.alias("second"))

    return bind(
        pixels,
        lambda p: bind(
            _doubled(padded_rows(p, height(), width(), radius), 2 * radius + 1, pick),
            lambda tables: bind(
                border_table(radius, height()),
                lambda ys: bind(F.transform(half, span), lambda spans: body(tables, ys, spans)),
            ),
        ),
    )


def default_ball_radius() -> Column:
    return F.greatest(F.lit(8), F.floor(F.least(height(), width()) / 8)).cast("int")


def background_opening(pixels: Column, radius: Column) -> Column:
    """Grey-scale opening (erosion then dilation) with a disk."""
    eroded = _disk_extreme(pixels, radius, F.least, F.array_min)
    return _disk_extreme(eroded, radius, F.greatest, F.array_max)


def rolling_ball_subtract(planes: DataFrame, radius: int | Column | None = None) -> DataFrame:
    """Subtract the opened background, clip at zero, result is a float32 plane."""
    if isinstance(radius, int):
        _check_radius("radius", radius)
    r = default_ball_radius() if radius is None else as_column(radius).cast("int")
    corrected = bind(
        background_opening(F.col("pixels"), r),
        lambda bg: F.zip_with("pixels", bg, lambda v, b: F.greatest(v - b, F.lit(0.0))),
    )
    return planes.withColumn("pixels", corrected).withColumn("dtype", F.lit("float32"))


def binary_opening(planes: DataFrame, mask: str = "mask") -> DataFrame:
    """Erosion then dilation with the 4-neighbour cross; the border never erodes."""

    def cross(m: Column, y: Column, x: Column, outside: bool) -> list[Column]:
        edge = F.lit(outside)
        here = y * width() + x
        return [
            F.get(m, here),
            F.when(y == 0, edge).otherwise(F.get(m, here - width())),
            F.when(y == height() - 1, edge).otherwise(F.get(m, here + width())),
            F.when(x == 0, edge).otherwise(F.get(m, here - 1)),
            F.when(x == width() - 1, edge).otherwise(F.get(m, here + 1)),
        ]

    def erode(m: Column) -> Column:
        def at(y, x):
            a, b, c, d, e = cross(m, y, x, True)
            return a & b & c & d & e

        return per_pixel(height(), width(), at)

    def dilate(m: Column) -> Column:
        def at(y, x):
            a, b, c, d, e = cross(m, y, x, False)
            return a | b | c | d | e

        return per_pixel(height(), width(), at)

    opened = bind(F.col(mask), lambda m: bind(erode(m), dilate))
    return planes.withColumn(mask, opened)


def local_threshold_mask(pixels: Column, block_size: Column, offset: Column) -> Column:
    """``v > gaussian local mean - offset`` with sigma = (block - 1) / 6."""
    weights = gaussian_weights(((block_size - 1) / 6.0).cast("double"))
    return bind(
        pixels,
        lambda p: F.zip_with(p, convolve_separable(p, weights), lambda v, m: v > m - offset),
    )


def adaptive_threshold(planes: DataFrame, block_size: int = 51, offset: float = 0.0) -> DataFrame:
    _check_block(block_size)
    return planes.withColumn(
        "mask", local_threshold_mask(F.col("pixels"), F.lit(block_size), F.lit(float(offset)))
    )


def _prefix_rows(rows: Column, columns: Column) -> Column:
    """Running sums down the lines, a line of zeros first. Lines are added whole: one addition per pixel."""
    return F.aggregate(
        rows,
        F.array(F.transform(positions(columns), lambda x: F.lit(0.0))),
        lambda done, row: F.concat(done, F.array(F.zip_with(F.element_at(done, -1), row, lambda a, v: a + v))),
    )


def summed_area(rows: Column, lines: Column, columns: Column) -> Column:
    """Sums over all rectangles from the corner: entry ``[x][y]`` covers ``x`` columns and ``y`` lines of ``rows``.

    Running sums down the lines, lines turned into columns, running sums again: three steps per pixel, whatever is
    asked of them afterwards.
    """
    turned = bind(
        _prefix_rows(rows, columns),
        lambda down: F.transform(positions(columns), lambda x: F.transform(down, lambda row: F.get(row, x))),
    )
    return _prefix_rows(turned, lines + 1)


def _box(strips: Column, y: Column, x: Column, size: Column) -> Column:
    return F.get(F.get(strips, x), y + size) - F.get(F.get(strips, x), y)


def _usable(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def sauvola_mask(pixels: Column, block_size: Column, k: float, r: Column) -> Column:
    """``v > m·(1 + k·(s/r - 1))`` with the mean and deviation of a square window.

    Windows are four look-ups in sums of the mirrored plane, so the time per pixel does not depend on the block. Sums
    are taken of differences to the plane's mean, which keeps small deviations on bright planes. A pixel whose window
    holds a null, NaN or infinite value is background.
    """
    radius = ((block_size - 1) / 2).cast("int")
    size = block_size.cast("int")
    count = (block_size * block_size).cast("double")

    def decide(p: Column, middle: Column, sums: Column) -> Column:
        def at(y, x):
            def above(mean: Column) -> Column:
                square = _box(sums["two"], y, x, size) / count
                deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
                return F.get(p, y * width() + x) > (mean + middle) * (1 + k * (deviation / r - 1))

            known = sums["odd"].isNull() | (_box(sums["odd"], y, x, size) == 0)
            return F.when(known, bind(_box(sums["one"], y, x, size) / count, above)).otherwise(False)

        return per_pixel(height(), width(), at)

    def strips(values: Column) -> Column:
        """Sums of ``size`` neighbouring columns of the mirrored plane, running down the lines."""
        lines = bind(
            padded_rows(values, height(), width(), radius, mirror_index),
            lambda rows: F.transform(border_table(radius, height(), mirror_index), lambda y: F.get(rows, y)),
        )
        return bind(
            summed_area(lines, height() + 2 * radius, width() + 2 * radius),
            lambda area: F.transform(
                positions(width()), lambda x: F.zip_with(F.get(area, x + size), F.get(area, x), lambda far, near: far - near)
            ),
        )

    def centred(p: Column, plane: Column) -> Column:
        apart = F.transform(p, lambda v: F.when(plane["usable"] | _usable(v), v - plane["middle"]).otherwise(0.0))
        flags = bind(F.transform(p, lambda v: F.when(_usable(v), 0.0).otherwise(1.0)), strips)
        return bind(
            apart,
            lambda d: bind(
                F.struct(
                    strips(d).alias("one"),
                    bind(F.transform(d, lambda v: v * v), strips).alias("two"),
                    F.when(~plane["usable"], flags).alias("odd"),
                ),
                lambda sums: decide(p, plane["middle"], sums),
            ),
        )

    def mask(p: Column) -> Column:
        good = F.filter(p, _usable)
        middle = F.coalesce(F.try_divide(total(good), F.size(good)), F.lit(0.0))
        plane = F.struct(F.forall(p, _usable).alias("usable"), middle.alias("middle"))
        return bind(plane, lambda known: centred(p, known))

    return bind(pixels, mask)


def sauvola_threshold(
    planes: DataFrame, block_size: int = 51, k: float = 0.2, r: float | Column | None = None
) -> DataFrame:
    _check_block(block_size)
    dynamic = F.array_max("pixels") if r is None else as_column(r).cast("double")
    dynamic = F.when(dynamic <= 0, F.lit(1.0)).otherwise(dynamic)
    return planes.withColumn(
        "mask", bind(dynamic, lambda d: sauvola_mask(F.col("pixels"), F.lit(block_size), k, d))
    )


def integral_image(planes: DataFrame, name: str = "integral") -> DataFrame:
    """Add the inclusive 2-D prefix sums of every plane as an array like ``pixels``; nulls count as zero.

    The sums are built inside the plane's row: nothing is exploded or shuffled.
    """

    def sums(p: Column) -> Column:
        rows = F.transform(
            positions(height()),
            lambda y: F.transform(positions(width()), lambda x: F.coalesce(F.get(p, y * width() + x).cast("double"), F.lit(0.0))),
        )
        return bind(
            summed_area(rows, height(), width()),
            lambda area: per_pixel(height(), width(), lambda y, x: F.get(F.get(area, x + 1), y + 1)),
        )

    return planes.withColumn(name, bind(F.col("pixels"), sums))
