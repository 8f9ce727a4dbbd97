"""Connected regions of masks, computed on run-length rows.

A mask is a table of runs ``(image_id, height, width, y, x0, x1)``: maximal stretches of
foreground in one image line. Runs are produced inside the plane row without a shuffle and
are far fewer than pixels; labelling, cleaning and measuring only ever move runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable, durable_counted, spread
from pixelframe.functions.arrays import bind, positions
from pixelframe.operators.ranking import chunked_ordinal

RUN_KEY = ["image_id", "y", "x0"]
TILE = 64


def _runs_of(mask: Column, width: Column) -> Column:
    """``array<struct<start,stop>>`` of raster positions of the runs of a flat mask."""

    def edges(m: Column) -> Column:
        where = positions(F.size(m))
        starts = F.filter(
            where, lambda i: F.get(m, i) & ((i % width == 0) | ~F.coalesce(F.get(m, i - 1), F.lit(False)))
        )
        stops = F.filter(
            where,
            lambda i: F.get(m, i)
            & (((i + 1) % width == 0) | ~F.coalesce(F.get(m, i + 1), F.lit(False))),
        )
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))

    return bind(mask, edges)


def mask_runs(
    planes: DataFrame, mask: str = "mask", intensity: str | None = None, inverted: bool = False
) -> DataFrame:
    """Run-length encode plane masks; narrow.

    ``intensity`` names a plane array whose sum and maximum over each run are kept as
    ``v_sum`` and ``v_max``, so measuring intensities later needs no second pass over pixels.
    """
    source = F.transform(mask, lambda m: ~m) if inverted else F.col(mask)
    runs = planes.select(
        "image_id",
        "height",
        "width",
        *([F.col(intensity).alias("_v")] if intensity else []),
        F.explode(_runs_of(source, F.col("width"))).alias("r"),
    )
    start, stop = F.col("r.start"), F.col("r.stop")
    columns = [
        F.col("image_id"),
        F.col("height"),
        F.col("width"),
        F.floor(start / F.col("width")).cast("int").alias("y"),
        (start % F.col("width")).cast("int").alias("x0"),
        (stop % F.col("width")).cast("int").alias("x1"),
    ]
    if intensity:
        segment = F.slice("_v", start + 1, stop - start + 1)
        columns += [
            F.aggregate(segment, F.lit(0.0), lambda a, v: a + v).alias("v_sum"),
            F.array_max(segment).alias("v_max"),
        ]
    return runs.select(*columns)


def runs_from_pixels(pixels: DataFrame) -> DataFrame:
    """Runs of a sparse foreground pixel table ``(image_id, height, width, y, x)``.

    Gaps and islands inside single image lines, so a window group is at most one line.
    """
    line = Window.partitionBy("image_id", "y").orderBy("x")
    return (
        pixels.withColumn("_island", F.col("x") - F.row_number().over(line))
        .groupBy("image_id", "height", "width", "y", "_island")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_island")
    )


def run_pixels(runs: DataFrame) -> DataFrame:
    """Foreground pixels of a run table (other run columns are repeated)."""
    rest = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*rest, F.explode(F.sequence("x0", "x1")).alias("x"))


def line_runs(runs: DataFrame) -> DataFrame:
    """One row per occupied image line with its runs in order (bounded by the line width)."""
    return runs.groupBy("image_id", "height", "width", "y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("line")
    )


def complement_runs(runs: DataFrame) -> DataFrame:
    """Runs of the background, for every image that has foreground.

    Each occupied line yields the gaps between its runs; lines without runs are one full gap.
    """
    bounded = F.concat(
        F.array(F.struct(F.lit(-1).alias("x0"), F.lit(-1).alias("x1"))),
        F.coalesce("line", F.array().cast("array<struct<x0:int,x1:int>>")),
        F.array(F.struct(F.col("width").alias("x0"), F.col("width").alias("x1"))),
    )
    gaps = bind(
        bounded,
        lambda b: F.filter(
            F.transform(
                positions(F.size(b) - 1),
                lambda i: F.struct(
                    (F.get(b, i)["x1"] + 1).alias("x0"), (F.get(b, i + 1)["x0"] - 1).alias("x1")
                ),
            ),
            lambda g: g["x0"] <= g["x1"],
        ),
    )
    lines = (
        runs.select("image_id", "height", "width")
        .distinct()
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    )
    return (
        lines.join(line_runs(runs), ["image_id", "height", "width", "y"], "left")
        .select("image_id", "height", "width", "y", F.explode(gaps).alias("g"))
        .select("image_id", "height", "width", "y", "g.x0", "g.x1")
    )


def merge_runs(runs: DataFrame) -> DataFrame:
    """Join touching or overlapping runs of a line into maximal runs."""
    line = Window.partitionBy("image_id", "y").orderBy("x0")
    reach = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("x0") > F.coalesce(reach, F.lit(-2)) + 1).cast("int")
    marked = runs.select("image_id", "height", "width", "y", "x0", "x1", opens.alias("_new"))
    numbered = marked.withColumn("_run", F.sum("_new").over(line))
    return (
        numbered.groupBy("image_id", "height", "width", "y", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_run")
    )


def touching_runs(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """Pairs of touching runs in neighbouring lines, ``(image_id, a, b)`` as raster ids.

    An interval join without a pair explosion: runs are cut into tiles of 64 columns, equal
    (image, line, tile) rows meet, and a pair is kept only in the tile where the overlap
    starts. The output is linear in the number of runs.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    slack = 1 if connectivity == 8 else 0
    ident = (F.col("y").cast("bigint") * F.col("width") + F.col("x0")).alias("id")
    upper = runs.select(
        "image_id",
        (F.col("y") + 1).alias("y"),
        ident,
        F.col("x0").alias("a0"),
        F.col("x1").alias("a1"),
        F.explode(F.sequence(F.floor(F.col("x0") / TILE), F.floor(F.col("x1") / TILE))).alias("tile"),
    ).withColumnRenamed("id", "a")
    low = F.greatest(F.col("x0") - slack, F.lit(0))
    lower = runs.select(
        "image_id",
        "y",
        ident,
        low.alias("b0"),
        (F.col("x1") + slack).alias("b1"),
        F.explode(F.sequence(F.floor(low / TILE), F.floor((F.col("x1") + slack) / TILE))).alias("tile"),
    ).withColumnRenamed("id", "b")
    overlap = (
        (F.col("a0") <= F.col("b1"))
        & (F.col("b0") <= F.col("a1"))
        & (F.floor(F.greatest("a0", "b0") / TILE) == F.col("tile"))
    )
    return upper.join(lower, ["image_id", "y", "tile"]).filter(overlap).select("image_id", "a", "b")


def component_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(image_id, id, root)``: smallest id of the connected component of every node.

    Contraction rounds: each node hooks to its smallest neighbour, chains of hooks are shortened
    by pointer doubling (four hooks per round), and the edges are rewritten onto the nodes
    reached. At least half of the still-connected nodes vanish per round, so the number of
    rounds grows with the logarithm of the largest component. Minima are partially aggregated
    before the shuffle, which also covers a component that spans most of the data. A round is
    one job: it writes the remaining edges and counts them on the way.
    """
    mapping = nodes.select("image_id", "id", F.col("id").alias("root"))
    links, open_links = durable_counted(edges.select("image_id", "a", "b").distinct())
    while open_links:
        both = links.unionByName(
            links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))
        )
        hooks = (
            both.groupBy("image_id", "a")
            .agg(F.min("b").alias("_m"))
            .select("image_id", F.col("a").alias("id"), F.least("a", "_m").alias("to"))
        )
        for _ in range(2):
            hooks = spread(_follow(spread(hooks, open_links), spread(hooks, open_links), "to"), open_links)
        mapping = _follow(mapping, hooks, "root")
        links, open_links = durable_counted(
            _follow(_follow(links, hooks, "a"), hooks, "b")
            .filter(F.col("a") != F.col("b"))
            .select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    return mapping


def _follow(df: DataFrame, hops: DataFrame, column: str) -> DataFrame:
    """Replace ids in ``column`` by the node they hooked to; ids without a hook stay."""
    target = hops.select("image_id", F.col("id").alias(column), F.col("to").alias("_to"))
    return (
        df.join(target, ["image_id", column], "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_to")
    )


def component_runs(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """Runs with ``root``: the raster position of the first pixel of their component.

    A written table: callers read it more than once, and the rounds are composed once.
    """
    runs = durable(runs)
    ident = F.col("y").cast("bigint") * F.col("width") + F.col("x0")
    with_id = runs.withColumn("id", ident)
    roots = component_roots(with_id.select("image_id", "id"), touching_runs(runs, connectivity))
    return durable(with_id.join(roots, ["image_id", "id"]).drop("id"))


def label_objects(runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """Runs with ``label`` 1..n per image, numbered by the first pixel in raster order."""
    rooted = component_runs(runs, connectivity)
    numbered = number_components(rooted)
    return rooted.join(numbered, ["image_id", "root"]).drop("root")


def number_components(rooted: DataFrame) -> DataFrame:
    """``(image_id, root, label)``; positions are counted per raster chunk, not per image."""
    roots = rooted.select("image_id", "root").distinct()
    return chunked_ordinal(roots, ["image_id"], "root", "label").withColumn(
        "label", F.col("label").cast("int")
    )


def count_objects(images: DataFrame, runs: DataFrame, connectivity: int = 8) -> DataFrame:
    """``(image_id, object_count)`` for every image, 0 when the mask is empty."""
    per_image = (
        component_runs(runs, connectivity)
        .select("image_id", "root")
        .distinct()
        .groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("object_count"))
    )
    return (
        images.select("image_id")
        .join(per_image, "image_id", "left")
        .withColumn("object_count", F.coalesce("object_count", F.lit(0).cast("bigint")))
    )


def component_stats(rooted: DataFrame) -> DataFrame:
    """Area and border contact of every component (partial aggregation)."""
    border = (
        (F.col("y") == 0)
        | (F.col("y") == F.col("height") - 1)
        | (F.col("x0") == 0)
        | (F.col("x1") == F.col("width") - 1)
    )
    return rooted.groupBy("image_id", "root").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.bool_or(border).alias("on_border")
    )


def _keep(rooted: DataFrame, condition: Column) -> DataFrame:
    chosen = component_stats(rooted).filter(condition).select("image_id", "root")
    return rooted.join(chosen, ["image_id", "root"], "left_semi").drop("root")


def remove_small_objects(runs: DataFrame, min_size: int = 20) -> DataFrame:
    """Drop 4-connected components with fewer than ``max(1, min_size)`` pixels."""
    return _keep(component_runs(runs, 4), F.col("area") >= max(1, min_size))


def remove_small_per_image(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Like :func:`remove_small_objects` with one minimum per image (``image_id, min_size``)."""
    rooted = component_runs(runs, 4)
    chosen = (
        component_stats(rooted)
        .join(sizes.select("image_id", "min_size"), "image_id")
        .filter(F.col("area") >= F.greatest(F.lit(1), "min_size"))
        .select("image_id", "root")
    )
    return rooted.join(chosen, ["image_id", "root"], "left_semi").drop("root")


def fill_holes(runs: DataFrame) -> DataFrame:
    """Turn background regions (4-connected) that do not reach the border into foreground."""
    base = runs.select("image_id", "height", "width", "y", "x0", "x1")
    holes = _keep(component_runs(complement_runs(base), 4), ~F.col("on_border"))
    return merge_runs(base.unionByName(holes.select(*base.columns)))


def clear_border(runs: DataFrame) -> DataFrame:
    """Drop 8-connected components that touch the image edge."""
    return _keep(component_runs(runs, 8), ~F.col("on_border"))


def clean_mask(
    runs: DataFrame, min_size: int = 20, fill: bool = True, clear: bool = True
) -> DataFrame:
    """Fill holes, remove small objects, clear the border — in this order."""
    cleaned = fill_holes(runs) if fill else runs
    cleaned = remove_small_objects(cleaned, min_size)
    return clear_border(cleaned) if clear else cleaned


def should_split(images: DataFrame, runs: DataFrame) -> DataFrame:
    """``(image_id, object_count, split)``: does the mask look like touching objects?

    One object covering more than 1 % of the plane, a largest object above three medians,
    or at most two objects covering more than 1.5 %.
    """
    areas = component_stats(component_runs(runs, 8))
    stats = areas.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("object_count"),
        F.median("area").alias("_median"),
        F.max("area").alias("_largest"),
        F.sum("area").alias("_foreground"),
    )
    n = F.coalesce("object_count", F.lit(0).cast("bigint"))
    fraction = F.col("_foreground") / (F.col("height").cast("bigint") * F.col("width"))
    split = (
        F.when(n == 0, F.lit(False))
        .when(n == 1, fraction > 0.01)
        .otherwise(
            (F.col("_largest") > 3.0 * F.col("_median")) | ((n <= 2) & (fraction > 0.015))
        )
    )
    return (
        images.select("image_id", "height", "width")
        .join(stats, "image_id", "left")
        .select("image_id", n.alias("object_count"), split.alias("split"))
    )


def attach_intensity(runs: DataFrame, planes: DataFrame, array: str = "pixels") -> DataFrame:
    """Add ``v_sum`` and ``v_max`` per run from the plane's image lines.

    Lines meet runs on (image_id, y): keys are single image lines, so a large image spreads
    over many tasks.
    """
    from pixelframe.sources.planes import scanlines

    lines = scanlines(planes, array).select("image_id", "y", "line")
    segment = F.slice("line", F.col("x0") + 1, F.col("x1") - F.col("x0") + 1)
    return (
        runs.drop("v_sum", "v_max")
        .join(lines, ["image_id", "y"])
        .withColumns(
            {
                "v_sum": F.aggregate(segment, F.lit(0.0), lambda a, v: a + v),
                "v_max": F.array_max(segment),
            }
        )
        .drop("line")
    )


def paint_runs(runs: Column, size: Column, inside, outside: Column) -> Column:
    """Flat plane array of ``size`` values from sorted ``array<struct<start,stop>>`` runs.

    ``inside(run)`` gives the values of one run, ``outside`` fills the gaps; each position is
    written once.
    """

    def segment(i: Column) -> Column:
        previous = F.coalesce(F.get(runs, i - 1)["stop"], F.lit(-1))
        run = F.get(runs, i)
        return F.concat(
            F.array_repeat(outside, (run["start"] - previous - 1).cast("int")), inside(run)
        )

    last = F.coalesce(F.try_element_at(runs, F.lit(-1))["stop"], F.lit(-1))
    return F.concat(
        F.flatten(F.transform(positions(F.size(runs)), segment)),
        F.array_repeat(outside, (size - last - 1).cast("int")),
    )


def runs_to_mask(planes: DataFrame, runs: DataFrame, mask: str = "mask") -> DataFrame:
    """Rebuild the plane's mask array from runs; an image's runs never exceed its plane row."""
    offset = F.col("y") * F.col("width")
    grouped = runs.groupBy("image_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (offset + F.col("x0")).alias("start"), (offset + F.col("x1")).alias("stop")
                )
            )
        ).alias("_runs")
    )
    painted = bind(
        F.coalesce("_runs", F.array().cast("array<struct<start:int,stop:int>>")),
        lambda r: paint_runs(
            r,
            F.col("height") * F.col("width"),
            lambda run: F.array_repeat(F.lit(True), (run["stop"] - run["start"] + 1).cast("int")),
            F.lit(False),
        ),
    )
    return (
        planes.drop(mask)
        .join(grouped, "image_id", "left")
        .withColumn(mask, painted)
        .drop("_runs")
    )
