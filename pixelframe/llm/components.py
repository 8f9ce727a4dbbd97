"""Connected components of a graph given by links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import discard, durable, durable_counted


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for every node of ``links`` (``src, dst``) the smallest node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one
    (large star), then its smaller neighbours to their smallest (small star). Each is one partially aggregated
    minimum and one join, so no neighbourhood is ever gathered; rounds grow with the logarithm of the longest
    chain. Every round is a written table, and the one before it is removed.
    """
    pairs = links.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    edges = durable(pairs.where("lo < hi").distinct())
    while True:
        large = _star(edges, larger=True)
        rounded = _star(large, larger=False)
        both = (
            edges.select("lo", "hi", F.lit(1).alias("old"))
            .unionByName(rounded.select("lo", "hi", F.lit(2).alias("old")))
            .groupBy("lo", "hi")
            .agg(F.bit_or("old").alias("seen"))
        )
        state, changed = durable_counted(both, F.col("seen") != 3)
        discard(edges)
        edges = durable(state.where("seen >= 2").select("lo", "hi")) if changed else None
        if edges is None:
            roots = durable(
                state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                    state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
                )
            )
            discard(state)
            return roots
        discard(state)


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Distinct ``lo, hi`` after moving the larger (or the smaller) neighbours of every node to its smallest one."""
    around = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    if larger:
        around = around.unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
        least = around.groupBy("node").agg(F.min("other").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        moved = around.where("other > node").join(least, "node").select(F.col("m").alias("lo"), F.col("other").alias("hi"))
    else:
        below = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        least = below.groupBy("node").agg(F.min("other").alias("m"))
        moved = below.join(least, "node").select(F.col("m").alias("lo"), F.col("other").alias("hi"))
        moved = moved.unionByName(least.select(F.col("m").alias("lo"), F.col("node").alias("hi")))
    return moved.where("lo < hi").distinct()
