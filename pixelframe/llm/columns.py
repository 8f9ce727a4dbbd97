"""Column picking that no other column of the input can disturb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def take(df: DataFrame, **wanted: str) -> DataFrame:
    """``take(df, new=old)``: only the named columns of ``df``, under new names.

    Columns are found by their exact spelling and position, so further columns with any names (also
    repeated ones, or ones that differ in case only) do no harm; the first of several is taken.
    """
    names = df.columns
    for old in wanted.values():
        if old not in names:
            raise ValueError(f"no column {old!r} among {names}")
    placed = df.toDF(*[f"_{i}" for i in range(len(names))])
    return placed.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items()])


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """``doc`` with all columns of a row, and the named ones beside it, as :func:`take` would find them."""
    names = df.columns
    for old in wanted.values():
        if old not in names:
            raise ValueError(f"no column {old!r} among {names}")
    whole = F.struct(*[F.col(f"_{i}") for i in range(len(names))]).alias("doc")
    beside = [F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items()]
    return df.toDF(*[f"_{i}" for i in range(len(names))]).select(whole, *beside)


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns in ``doc`` under their names again; ``changed`` replaces the first column of a name."""
    places = {names.index(name): value for name, value in changed.items() if name in names}
    return df.select(*[places.get(i, F.col(f"doc._{i}")).alias(name) for i, name in enumerate(names)])


def row_key(*columns: str) -> Column:
    """128 bits that stand for the values of the columns, nulls told apart from all values."""
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *marked).cast("binary")))
