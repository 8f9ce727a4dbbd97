"""Image planes: one row per 2-D plane with its pixels in one array, and views of them.

Columns: ``image_id, stack_id, source_path, frame_index, z_index, t_index, c_index,
height, width, dtype, pixels array<double>``. Only ``image_id, height, width, dtype,
pixels`` are needed by the array operators; identity columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.functions.names import basename
from pixelframe.operators.ranking import ordinal

PLANES_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType(), False),
        T.StructField("stack_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("z_index", T.IntegerType()),
        T.StructField("t_index", T.IntegerType()),
        T.StructField("c_index", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("pixels", T.ArrayType(T.DoubleType())),
    ]
)


def planes_source(spark: SparkSession, path: str) -> DataFrame:
    """Scan stored planes. The schema is fixed, so nothing is inferred from the files."""
    return spark.read.schema(PLANES_SCHEMA).parquet(path)


def planes_from_arrays(
    df: DataFrame,
    *,
    image_id: str,
    values: str,
    height: int,
    width: int,
    dtype: str = "float64",
    stack_id: str | None = None,
) -> DataFrame:
    """Treat a table with one fixed-size vector per row as a table of planes."""
    return df.select(
        F.col(image_id).alias("image_id"),
        (F.col(stack_id) if stack_id else F.lit(None).cast("string")).alias("stack_id"),
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        F.lit(dtype).alias("dtype"),
        F.col(values).cast("array<double>").alias("pixels"),
    )


def explode_pixels(planes: DataFrame, **values: str) -> DataFrame:
    """Plane rows → pixel rows ``(…identity…, y, x, v)``; narrow.

    ``values`` names further output columns and the plane array each one reads, by
    default ``v="pixels"``; the arrays must describe the same plane.
    """
    values = values or {"v": "pixels"}
    arrays = list(values.values())
    keep = [f.name for f in planes.schema.fields if not isinstance(f.dataType, T.ArrayType)]
    if len(arrays) == 1:
        exploded = planes.select(*keep, F.posexplode(arrays[0]).alias("_pos", "_v"))
        columns = [F.col("_v").alias(next(iter(values)))]
    else:
        zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in values.items()])
        exploded = planes.select(*keep, F.posexplode(zipped).alias("_pos", "_v"))
        columns = [F.col("_v").getField(n).alias(n) for n in values]
    return exploded.select(
        *keep,
        F.floor(F.col("_pos") / F.col("width")).cast("int").alias("y"),
        (F.col("_pos") % F.col("width")).cast("int").alias("x"),
        *columns,
    )


def scanlines(planes: DataFrame, array: str = "pixels") -> DataFrame:
    """Plane rows → one row per image line ``(image_id, y, line)``; narrow."""
    return planes.select(
        "image_id",
        "height",
        "width",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("height") - 1),
                lambda y: F.slice(F.col(array), y * F.col("width") + 1, F.col("width")),
            )
        ).alias("y", "line"),
    )


def interpret_axes(shape: Column, meta: Column | None = None) -> Column:
    """Axis counts of an array shape as ``struct<height,width,z_count,t_count,c_count,source>``.

    ``meta`` is an optional ``map<string,int>`` with ``slices/frames/channels``; when it is
    present it decides the counts, otherwise the leading dimensions do.
    """
    rank = F.size(shape)
    lead = rank - 2

    def dim(i: int) -> Column:
        return F.get(shape, F.lit(i)).cast("int")

    one = F.lit(1)
    product = F.aggregate(
        F.slice(shape, F.lit(1), F.greatest(lead, F.lit(0))),
        F.lit(1).cast("bigint"),
        lambda acc, n: acc * n,
    ).cast("int")
    z = F.when(lead == 0, one).when(lead <= 2, dim(0)).when(lead == 3, dim(1)).otherwise(product)
    t = F.when(lead == 3, dim(0)).otherwise(one)
    c = F.when(lead == 2, dim(1)).when(lead == 3, dim(2)).otherwise(one)
    source = F.lit("inferred")
    if meta is not None:
        known = meta.isNotNull()

        def count(key: str) -> Column:
            return F.greatest(one, F.coalesce(F.try_element_at(meta, F.lit(key)).cast("int"), one))

        z = F.when(known, count("slices")).otherwise(z)
        t = F.when(known, count("frames")).otherwise(t)
        c = F.when(known, count("channels")).otherwise(c)
        source = F.when(known, F.lit("metadata")).otherwise(source)
    axes = F.struct(
        F.element_at(shape, -2).cast("int").alias("height"),
        F.element_at(shape, -1).cast("int").alias("width"),
        z.alias("z_count"),
        t.alias("t_count"),
        c.alias("c_count"),
        source.alias("source"),
    )
    return F.when(
        rank < 2, F.raise_error(F.lit("image shape must have at least 2 dimensions"))
    ).otherwise(axes)


def frame_axis_indices(
    df: DataFrame, index: str, z_count: Column, c_count: Column, has_meta: Column
) -> DataFrame:
    """Linear plane index → ``c_index, z_index, t_index``.

    The channel runs fastest. Without metadata the index is a depth index and the other two
    are unknown.
    """
    i = F.col(index)
    return df.withColumns(
        {
            "c_index": F.when(has_meta, i % c_count).cast("int"),
            "z_index": F.when(has_meta, F.floor(i / c_count) % z_count).otherwise(i).cast("int"),
            "t_index": F.when(has_meta, F.floor(i / (c_count * z_count))).cast("int"),
        }
    )


def select_plane(planes: DataFrame, frame_index: int = 0, strict: bool = True) -> DataFrame:
    """The ``frame_index``-th plane of every stack.

    With ``strict`` a stack that has no such plane is an error, raised while the query runs.
    The check keeps one small row per stack (partial aggregation), not the pixels.
    """
    if frame_index < 0:
        raise ValueError(f"frame_index {frame_index} is out of range")
    chosen = planes.filter(F.col("frame_index") == frame_index)
    if not strict:
        return chosen
    short = (
        planes.groupBy("stack_id")
        .agg(F.max("frame_index").alias("_last"))
        .filter(F.col("_last") < frame_index)
        .select(
            F.raise_error(
                F.format_string(
                    f"frame_index {frame_index} is out of range for %s frame(s) in stack %s",
                    F.col("_last") + 1,
                    F.col("stack_id").cast("string"),
                )
            ).alias("_error")
        )
        .filter(F.col("_error").isNotNull())
    )
    return _guarded(chosen, short)


def _guarded(chosen: DataFrame, failing: DataFrame) -> DataFrame:
    """Rows of ``chosen``, failing at run time when ``failing`` yields anything."""
    columns = chosen.columns
    tagged = chosen.withColumn("_error", F.lit(None).cast("string"))
    errors = failing.select(
        *[F.lit(None).cast(chosen.schema[c].dataType).alias(c) for c in columns], F.col("_error").cast("string")
    )
    return tagged.unionByName(errors).filter(F.col("_error").isNull()).select(*columns)


def first_channel(planes: DataFrame, shape: str = "shape") -> DataFrame:
    """Reduce a flat 2-D or 3-D array (row-major ``pixels``, ``shape``) to one plane.

    Three dimensions with a leading size of at most 4 are channels-first (take the first
    block), any other three are channels-last (take every n-th value).
    """
    s = F.col(shape)
    rank = F.size(s)
    channels_first = (rank == 3) & (F.get(s, F.lit(0)) <= 4)
    height = F.when((rank == 2) | ~channels_first, F.get(s, F.lit(0))).otherwise(F.get(s, F.lit(1)))
    width = F.when((rank == 2) | ~channels_first, F.get(s, F.lit(1))).otherwise(F.get(s, F.lit(2)))
    plane = (
        F.when(rank == 2, F.col("pixels"))
        .when(channels_first, F.slice("pixels", F.lit(1), height * width))
        .when(
            rank == 3,
            F.filter("pixels", lambda v, i: i % F.element_at(s, -1) == 0),
        )
        .otherwise(
            F.raise_error(F.format_string("unsupported image dimensionality: %dD", rank)).cast(
                "array<double>"
            )
        )
    )
    return planes.withColumns(
        {"pixels": plane, "height": height.cast("int"), "width": width.cast("int")}
    )


def folder_as_stack(planes: DataFrame, stack: str = "stack_id", path: str = "source_path") -> DataFrame:
    """One frame per file in path order, only the first plane of each file.

    Repeated file names inside a stack keep the smallest path. Numbering is spread over
    range partitions, so a folder of any size is never sorted in one task.
    """
    first = planes
    if "page_index" in planes.columns:
        first = planes.filter(F.col("page_index") == 0)
    unique = (
        first.groupBy(stack, basename(F.col(path)).alias("_name"))
        .agg(F.min(path).alias(path))
        .drop("_name")
    )
    ordered = ordinal(unique, [stack], [path], "frame_index")
    frames = ordered.select(
        stack,
        path,
        (F.col("frame_index") - 1).cast("int").alias("frame_index"),
        (F.col("frame_index") - 1).cast("int").alias("z_index"),
        F.lit(0).alias("t_index"),
        F.lit(0).alias("c_index"),
    )
    rest = [c for c in first.columns if c not in frames.columns]
    return first.select(stack, path, *rest).join(frames, [stack, path])


def stack_summary(planes: DataFrame) -> DataFrame:
    """Frame count and the shape of the first frame, per stack (one partial aggregation)."""
    first = F.min_by(F.struct("height", "width"), F.col("frame_index"))
    return planes.groupBy("stack_id").agg(
        F.count(F.col("frame_index")).alias("frame_count"),
        first.getField("height").alias("height"),
        first.getField("width").alias("width"),
    )


def frame_order(planes: DataFrame) -> DataFrame:
    """Name tag and file prefix of every frame; order by (stack_id, frame_index) to list them."""
    from pixelframe.functions.names import frame_tag, stem

    return planes.withColumn("frame_tag", frame_tag(F.col("frame_index"))).withColumn(
        "prefix",
        F.concat_ws(
            "_",
            F.coalesce(
                stem(F.col("source_path")), F.format_string("frame_%03d", F.col("frame_index").cast("int"))
            ),
            F.col("frame_tag"),
        ),
    )
