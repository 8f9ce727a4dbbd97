"""Numbering rows inside groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable


def _beside(df: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    """``df`` with the ``_before`` of its group; a null key is a group like any other."""
    named = offsets.select(*[F.col(c).alias(f"_key{k}") for k, c in enumerate(group)], "_before")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key{k}")) for k, c in enumerate(group)])
    return df.join(named, same).drop(*[f"_key{k}" for k in range(len(group))])


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = 1-based position inside each key group, by ``order`` ascending.

    Rows are range-partitioned on (keys, order), so one hot group spans many partitions.
    Each partition numbers its own rows; partition totals (at most one row per key and
    partition) give the offsets. The partition ids are materialised first because both
    branches must see the same boundaries.
    """
    parted = durable(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    group = [*keys, "_part"]
    sizes = parted.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        _beside(parted.withColumn("_local", local), offsets, group)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", "_part")
    )


def chunked_ordinal(
    df: DataFrame, keys: Sequence[str], order: str, name: str, chunk: int = 65_536
) -> DataFrame:
    """Like :func:`ordinal` for an integer position column that is dense by nature.

    Raster positions and line numbers fall into fixed chunks of ``chunk`` positions, so the
    split needs no sampling and no materialisation.
    """
    with_chunk = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    group = [*keys, "_chunk"]
    sizes = with_chunk.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return (
        _beside(with_chunk.withColumn("_local", local), offsets, group)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", "_chunk")
    )


def running_count(
    df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str, chunk: int = 65_536
) -> DataFrame:
    """Add ``name`` = number of flagged rows up to and including this row, per key group.

    ``order`` is a line number; totals per chunk of lines carry over as offsets, so a huge
    log file is split over tasks instead of being windowed whole.
    """
    with_chunk = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn(
        "_flag", flag.cast("bigint")
    )
    group = [*keys, "_chunk"]
    totals = with_chunk.groupBy(*group).agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _beside(with_chunk.withColumn("_local", F.sum("_flag").over(upto)), offsets, group)
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_chunk", "_flag")
    )
