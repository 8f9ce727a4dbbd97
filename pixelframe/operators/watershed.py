"""Distance transform, peak markers and marker-controlled flooding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pixelframe.durable import discard, durable, durable_counted, spread
from pixelframe.functions.arrays import bind, height, positions, width
from pixelframe.operators.distance import with_distances
from pixelframe.operators.ranking import ordinal
from pixelframe.operators.regions import (
    component_runs,
    label_objects,
    mask_runs,
    run_pixels,
)
from pixelframe.workers import prepare


def distance_transform(planes: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds ``distance``: exact Euclidean distance to the nearest background pixel.

    Narrow: planes stay in their partitions and NumPy works on many of them at once, along columns and then along
    lines, where a pixel costs as many steps as a line can be halved, however solid the mask is. A plane without any
    background has no defined distance and yields nulls.
    """
    prepare(planes.sparkSession)
    given = planes.drop("distance")
    schema = StructType([*given.schema.fields, StructField("distance", ArrayType(DoubleType()))])
    return given.mapInArrow(lambda batches: with_distances(batches, mask), schema)


def peak_candidates(planes: DataFrame, min_distance: int = 8, ratio: float = 0.5) -> DataFrame:
    """Window maxima of ``distance`` above ``ratio`` of the plane maximum; narrow.

    The window reaches ``min_distance`` pixels in both directions.
    """
    d = max(1, min_distance)

    def window_max(p: Column, y: Column, x: Column) -> Column:
        left = F.greatest(x - d, F.lit(0))
        span = F.least(x + d, width() - 1) - left + 1
        return F.array_max(
            F.transform(
                F.sequence(F.greatest(y - d, F.lit(0)), F.least(y + d, height() - 1)),
                lambda r: F.array_max(F.slice(p, r * width() + left + 1, span)),
            )
        )

    def select(p: Column) -> Column:
        return bind(
            F.array_max(p),
            lambda peak: F.filter(
                positions(F.size(p)),
                lambda i: (F.get(p, i) > peak * ratio)
                & (F.get(p, i) > 0)
                & (F.get(p, i) == window_max(p, F.floor(i / width()).cast("int"), i % width())),
            ),
        )

    found = bind(
        F.col("distance"),
        lambda p: F.transform(
            select(p), lambda i: F.struct(i.alias("pos"), F.get(p, i).alias("distance"))
        ),
    )
    return planes.select("image_id", "width", F.explode(found).alias("c")).select(
        "image_id",
        F.floor(F.col("c.pos") / width()).cast("int").alias("y"),
        (F.col("c.pos") % width()).cast("int").alias("x"),
        F.col("c.distance").alias("distance"),
    )


def _conflicts(candidates: DataFrame, d: int) -> DataFrame:
    """Pairs of candidates closer than ``d`` (Chebyshev), better-ranked one first.

    Candidates meet through cells of side ``d`` and their eight neighbours; a cell holds at
    most d² pixels, so a key never grows with the data.
    """
    cell = [F.floor(F.col("y") / d).alias("cy"), F.floor(F.col("x") / d).alias("cx")]
    left = candidates.select(
        "image_id", F.struct((-F.col("distance")).alias("nd"), "y", "x").alias("p"), *cell
    )
    around = F.sequence(F.lit(-1), F.lit(1))
    right = (
        candidates.select(
            "image_id", F.struct((-F.col("distance")).alias("nd"), "y", "x").alias("q"), *cell
        )
        .withColumn("dy", F.explode(around))
        .withColumn("dx", F.explode(around))
        .select(
            "image_id",
            "q",
            (F.col("cy") + F.col("dy")).alias("cy"),
            (F.col("cx") + F.col("dx")).alias("cx"),
        )
    )
    near = (F.abs(F.col("p.y") - F.col("q.y")) < d) & (F.abs(F.col("p.x") - F.col("q.x")) < d)
    return (
        left.join(right, ["image_id", "cy", "cx"])
        .filter(near & (F.col("p") < F.col("q")))
        .select("image_id", "p", "q")
    )


def peak_markers(planes: DataFrame, min_distance: int = 8, ratio: float = 0.5) -> DataFrame:
    """Well-spaced peaks ``(image_id, y, x, distance, marker)``, best peak first.

    Greedy spacing in rank order (distance descending, then raster order), done set-wise: a
    candidate without a better undecided rival is kept, its rivals go, and the rest is decided
    in the next round.
    """
    d = max(1, min_distance)
    candidates = durable(peak_candidates(planes, d, ratio))
    node = F.struct((-F.col("distance")).alias("nd"), "y", "x").alias("p")
    rivals, undecided = durable_counted(_conflicts(candidates, d))
    removed = None
    while undecided:
        blocked = rivals.select("image_id", F.col("q").alias("p")).distinct()
        winners = (
            rivals.select("image_id", "p").distinct().join(blocked, ["image_id", "p"], "left_anti")
        )
        losers = durable(
            rivals.join(winners, ["image_id", "p"], "left_semi").select("image_id", "q").distinct()
        )
        removed = losers if removed is None else durable(removed.unionByName(losers))
        decided = spread(winners.unionByName(losers.select("image_id", F.col("q").alias("p"))), undecided)
        rivals, undecided = durable_counted(
            rivals.join(decided, ["image_id", "p"], "left_anti").join(
                losers, ["image_id", "q"], "left_anti"
            )
        )
    kept = candidates.select("image_id", node)
    if removed is not None:
        kept = kept.join(removed.select("image_id", F.col("q").alias("p")), ["image_id", "p"], "left_anti")
    ranked = ordinal(kept, ["image_id"], ["p"], "marker")
    return ranked.select(
        "image_id",
        F.col("p.y").alias("y"),
        F.col("p.x").alias("x"),
        (-F.col("p.nd")).alias("distance"),
        F.col("marker").cast("int").alias("marker"),
    )


def flood(pixels: DataFrame, markers: DataFrame) -> DataFrame:
    """Grow markers over ``pixels (image_id, y, x, distance)``: ``(image_id, y, x, marker)``.

    A pixel joins the marker whose path to it stays deepest, ties going to the shorter path
    and then to the smaller marker. Rounds relax only the neighbours of pixels that changed in
    the previous round; the state is checkpointed reliably every round.
    """
    cost = F.struct(
        (-F.col("distance")).alias("level"), F.lit(0).alias("hops"), F.col("marker")
    )
    state, moved = durable_counted(
        pixels.join(markers.select("image_id", "y", "x", "marker"), ["image_id", "y", "x"], "left")
        .withColumn("cost", F.when(F.col("marker").isNotNull(), cost))
        .select(
            "image_id",
            "y",
            "x",
            "distance",
            "cost",
            F.col("marker").isNotNull().alias("fixed"),
            F.col("marker").isNotNull().alias("changed"),
        ),
        F.col("changed"),
    )
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    while moved:
        offers = (
            state.filter("changed")
            .withColumn("s", F.explode(steps))
            .groupBy(
                "image_id",
                (F.col("y") + F.col("s.dy")).alias("y"),
                (F.col("x") + F.col("s.dx")).alias("x"),
            )
            .agg(F.collect_set("cost").alias("offers"))
        )
        reached = F.array_min(
            F.transform(
                "offers",
                lambda o: F.struct(
                    F.greatest(o["level"], -F.col("distance")).alias("level"),
                    (o["hops"] + 1).alias("hops"),
                    o["marker"].alias("marker"),
                ),
            )
        )
        better = (
            F.col("reached").isNotNull()
            & ~F.col("fixed")
            & (F.col("cost").isNull() | (F.col("reached") < F.col("cost")))
        )
        state, moved = durable_counted(
            state.drop("changed")
            .join(offers, ["image_id", "y", "x"], "left")
            .withColumn("reached", reached)
            .withColumn("changed", F.coalesce(better, F.lit(False)))
            .withColumn("cost", F.when(F.col("changed"), F.col("reached")).otherwise(F.col("cost")))
            .select("image_id", "y", "x", "distance", "cost", "fixed", "changed"),
            F.col("changed"),
        )
    return state.filter(F.col("cost").isNotNull()).select(
        "image_id", "y", "x", F.col("cost.marker").alias("marker")
    )


def _place() -> Column:
    """Pixels numbered in raster order, whatever the width."""
    return F.col("y").cast("bigint") * (1 << 31) + F.col("x")


def _links(pixels: DataFrame, markers: DataFrame) -> DataFrame:
    """Neighbouring pixels as ``(image_id, w, u, mu, v, mv)``: two nodes with their markers, and the link's rank ``w``:
    the level at which it is flooded, ties in raster order."""
    seeds = markers.select("image_id", "y", "x", "marker")
    nodes = durable(
        pixels.join(seeds, ["image_id", "y", "x"], "left").select(
            "image_id", "y", "x", _place().alias("at"), (-F.col("distance")).alias("level"), "marker"
        )
    )
    after = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0))])).alias("s")
    ahead = nodes.select("image_id", "at", "level", "marker", "y", "x", after).select(
        "image_id", F.col("at").alias("u"), F.col("level").alias("lu"), F.col("marker").alias("mu"),
        (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"),
    )
    met = ahead.join(nodes.select("image_id", "y", "x", F.col("at").alias("v"), F.col("level").alias("lv"), F.col("marker").alias("mv")), ["image_id", "y", "x"])
    rank = F.struct(F.greatest("lu", "lv").alias("level"), F.col("u").alias("a"), F.col("v").alias("b"))
    return met.select("image_id", rank.alias("w"), "u", "mu", "v", "mv").where("mu IS NULL OR mv IS NULL")


def _attached(links: DataFrame) -> DataFrame:
    """``(image_id, node, up, marker)`` for every node without a marker: where its first link leads in the end.

    Every such node follows its lowest-ranked link. Ranks differ, so the way ends at a node with a marker, or at two
    nodes that chose each other, of which the smaller one is the end. Ways are halved round by round.
    """
    choice = F.struct("w", "up", "marker")
    out = links.where("mu IS NULL").select("image_id", F.col("u").alias("node"), F.col("v").alias("up"), F.col("mv").alias("marker"), "w")
    back = links.where("mv IS NULL").select("image_id", F.col("v").alias("node"), F.col("u").alias("up"), F.col("mu").alias("marker"), "w")
    first = durable(out.unionByName(back).groupBy("image_id", "node").agg(F.min(choice).alias("c")).select("image_id", "node", "c.up", "c.marker"))
    other = first.select("image_id", F.col("node").alias("up"), F.col("up").alias("next"))
    mutual = (F.col("next") == F.col("node")) & (F.col("node") < F.col("up"))
    up = F.when(F.coalesce(mutual, F.lit(False)), F.col("node")).otherwise(F.col("up")).alias("to")
    way = first.join(other, ["image_id", "up"], "left").select("image_id", "node", up, "marker")
    way = way.select("image_id", "node", F.col("to").alias("up"), "marker", (F.col("marker").isNotNull() | (F.col("to") == F.col("node"))).alias("done"))
    state, open_ways = durable_counted(way, ~F.col("done"))
    while open_ways:
        far = state.select("image_id", F.col("node").alias("up"), F.col("up").alias("to"), F.col("marker").alias("m"), F.col("done").alias("d"))
        jumped = state.join(far, ["image_id", "up"], "left").select(
            "image_id",
            "node",
            F.when(F.col("done"), F.col("up")).otherwise(F.col("to")).alias("up"),
            F.coalesce("marker", "m").alias("marker"),
            (F.col("done") | F.col("d")).alias("done"),
        )
        before = state
        state, open_ways = durable_counted(jumped, ~F.col("done"))
        discard(before)
    return state.drop("done")


def flood_forest(pixels: DataFrame, markers: DataFrame) -> DataFrame:
    """Grow markers over ``pixels (image_id, y, x, distance)``: ``(image_id, y, x, marker)``.

    The minimum spanning forest of neighbouring pixels, cut so that every tree holds one marker: links are taken from
    the deepest up, ties in raster order, and none joins two markers. A pixel so joins a marker whose path to it stays
    as deep as any. It is built in rounds in which every part without a marker follows its first link; parts at least
    halve every time, so rounds grow with the logarithm of the pixels of a region, whatever its shape, and only links
    between parts that are still apart move. What the parts were joined to is read back from the last round to the
    first, over tables that shrink likewise. Pixels that no marker reaches are left out.
    """
    links, left = durable_counted(_links(pixels, markers))
    rounds = []
    while left:
        joined = _attached(links)
        rounds.append(joined)
        moved = links
        for end, mark in (("u", "mu"), ("v", "mv")):
            to = joined.select("image_id", F.col("node").alias(end), F.col("up").alias("to"), F.col("marker").alias("m"))
            moved = moved.join(to, ["image_id", end], "left").withColumns(
                {end: F.coalesce("to", end), mark: F.coalesce("m", mark)}
            ).drop("to", "m")
        before = links
        links, left = durable_counted(moved.where("u != v AND (mu IS NULL OR mv IS NULL)"))
        discard(before)
    found = None
    for joined in reversed(rounds):
        own = joined.select("image_id", "node", "up", "marker")
        if found is not None:
            later = found.select("image_id", F.col("node").alias("up"), F.col("marker").alias("m"))
            own = own.join(later, ["image_id", "up"], "left").select("image_id", "node", F.coalesce("marker", "m").alias("marker"))
        found = durable(own.select("image_id", "node", "marker"))
    seeds = markers.select("image_id", "y", "x", "marker")
    if found is None:
        return seeds
    grown = found.where(F.col("marker").isNotNull()).select(
        "image_id", F.expr("CAST(node DIV 2147483648 AS INT)").alias("y"), (F.col("node") % (1 << 31)).cast("int").alias("x"), "marker"
    )
    return seeds.unionByName(grown)


#: Ways to grow markers: along deepest and then shortest paths, or over a spanning forest in few rounds.
FLOODING = {"paths": flood, "forest": flood_forest}


def runs_from_labels(pixels: DataFrame) -> DataFrame:
    """Labelled runs from ``(image_id, height, width, y, x, label)`` pixel rows."""
    line = Window.partitionBy("image_id", "y", "label").orderBy("x")
    return (
        pixels.withColumn("_island", F.col("x") - F.row_number().over(line))
        .groupBy("image_id", "height", "width", "y", "label", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def split_touching(
    planes: DataFrame, min_distance: int = 8, min_peak_ratio: float = 0.5, mask: str = "mask", flooding: str = "paths"
) -> DataFrame:
    """Labelled runs of plane masks with touching objects split at their necks.

    ``flooding`` names how markers grow (:data:`FLOODING`); both ways agree but for pixels that several markers reach
    at the same level.

    Regions with one marker take its label directly and regions with none stay background, so
    only regions with several markers are flooded. Images whose mask has no peak at all fall
    back to plain connected labels.
    """
    slim = planes.select("image_id", "height", "width", F.col(mask).alias("mask"))
    runs = component_runs(mask_runs(slim), 4)
    measured = durable(distance_transform(slim).select("image_id", "height", "width", "distance"))
    markers = durable(peak_markers(measured, min_distance, min_peak_ratio))

    seeds = markers.join(
        runs.select("image_id", "y", "x0", "x1", "root"), ["image_id", "y"]
    ).filter(F.col("x").between(F.col("x0"), F.col("x1")))
    per_region, several = durable_counted(
        seeds.groupBy("image_id", "root").agg(
            F.count(F.lit(1)).alias("seeds"), F.min("marker").alias("label")
        ),
        F.col("seeds") > 1,
    )
    single = runs.join(
        per_region.filter("seeds = 1").select("image_id", "root", "label"), ["image_id", "root"]
    ).select("image_id", "height", "width", "y", "x0", "x1", "label")

    crowded = runs.join(
        per_region.filter("seeds > 1").select("image_id", "root"), ["image_id", "root"], "left_semi"
    ).select("image_id", "height", "width", "y", "x0", "x1")
    lines = scan_distance(measured)
    shape = spread(crowded.select("image_id", "height", "width").distinct(), several)
    crowded_pixels = (
        crowded.join(lines, ["image_id", "y"])
        .select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "line")
        .select("image_id", "y", "x", F.get("line", F.col("x")).alias("distance"))
    )
    crowded_seeds = spread(
        seeds.join(per_region.filter("seeds > 1").select("image_id", "root"), ["image_id", "root"], "left_semi"), several
    )
    grown = FLOODING[flooding](crowded_pixels, crowded_seeds).withColumnRenamed("marker", "label")
    flooded = runs_from_labels(grown.join(shape, "image_id"))

    unmarked = runs.join(markers.select("image_id").distinct(), "image_id", "left_anti")
    fallback = label_objects(unmarked.drop("root"), 8)
    columns = ["image_id", "height", "width", "y", "x0", "x1", "label"]
    return single.unionByName(flooded.select(*columns)).unionByName(fallback.select(*columns))


def scan_distance(measured: DataFrame) -> DataFrame:
    from pixelframe.sources.planes import scanlines

    return scanlines(measured, "distance").select("image_id", "y", "line")


__all__ = [
    "distance_transform",
    "flood",
    "flood_forest",
    "peak_candidates",
    "peak_markers",
    "run_pixels",
    "runs_from_labels",
    "split_touching",
]
