"""Column helpers for pixels held as one array per plane.

Everything here is a plain Catalyst expression: no Python runs on the executors and
no rows are exploded, so the operators built on these helpers are narrow (shuffle-free).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def height() -> Column:
    return F.col("height")


def width() -> Column:
    return F.col("width")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An array computed by an outer expression would otherwise be inlined into a lambda
    and evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def stddev_pop(values: Column) -> Column:
    """Population standard deviation (two passes, like a dense array library)."""
    return bind(
        mean(values),
        lambda m: F.sqrt(
            F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / F.size(values)
        ),
    )


def percentile_of_sorted(ordered: Column, q: float) -> Column:
    """Linear-interpolated percentile of an already sorted array, ``q`` in [0, 1]."""
    rank = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(rank)
    high = F.ceil(rank)
    a, b = F.get(ordered, low.cast("int")), F.get(ordered, high.cast("int"))
    return a + (b - a) * (rank - low)


def positions(n: Column) -> Column:
    """``[0 .. n-1]``; an empty array when ``n`` is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def power_of_two(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def as_column(value: int | float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def reflect_index(i: Column, n: Column) -> Column:
    """Half-sample symmetric border ``d c b a | a b c d | d c b a`` for any offset."""
    folded = F.pmod(i, 2 * n)
    return F.when(folded < n, folded).otherwise(2 * n - 1 - folded).cast("int")


def mirror_index(i: Column, n: Column) -> Column:
    """Whole-sample symmetric border ``d c b | a b c d | c b a`` for any offset."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    folded = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).when(folded < n, folded).otherwise(period - folded).cast("int")


def border_table(
    radius: int | Column, n: Column, rule: Callable[[Column, Column], Column] = reflect_index
) -> Column:
    """Source index of every padded position ``-radius .. n-1+radius``."""
    r = as_column(radius).cast("int")
    return F.transform(F.sequence(-r, (n - 1 + r).cast("int")), lambda i: rule(i, n))


def padded_rows(
    pixels: Column,
    height: Column,
    width: Column,
    radius: int | Column,
    rule: Callable[[Column, Column], Column] = reflect_index,
) -> Column:
    """Plane as ``array<array<double>>`` with ``radius`` border columns on either side."""
    return bind(
        border_table(radius, width, rule),
        lambda source: F.transform(
            positions(height),
            lambda y: F.transform(source, lambda x: F.get(pixels, y * width + x)),
        ),
    )


def per_pixel(height: Column, width: Column, body: Callable[[Column, Column], Column]) -> Column:
    """Flat plane array whose element at (y, x) is ``body(y, x)``."""
    return F.flatten(
        F.transform(
            positions(height), lambda y: F.transform(positions(width), lambda x: body(y, x))
        )
    )
