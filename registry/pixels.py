"""Checked queries over planes and pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.functions import names
from pixelframe.operators import compare, histogram, layers, measure, pixelwise, stats, stencil
from pixelframe.sources import planes as sources
from registry import query
from registry.inputs import (
    FRAMES,
    IPX,
    PX,
    SHEETS,
    blur_sql,
    framed_planes,
    int_planes,
    otsu_sql,
    planes,
    sheets,
    table,
)


def pixel_rows(df, array="pixels", name="v"):
    return sources.explode_pixels(df.select("image_id", "width", array), **{name: array}).select(
        "image_id", "y", "x", name
    )


# --- sources and views -----------------------------------------------------------------------


@query(
    "planes_source",
    """SELECT vec_id AS image_id, label AS stack_id, 8 AS height, 8 AS width,
       CAST(len(embedding) AS INTEGER) AS n_pixels, CAST(embedding[1] AS DOUBLE) AS first_pixel
       FROM embeddings""",
)
def _(spark, d):
    return planes(spark, d).select(
        "image_id",
        "stack_id",
        "height",
        "width",
        F.size("pixels").alias("n_pixels"),
        F.get("pixels", F.lit(0)).alias("first_pixel"),
    )


@query("explode_pixels", f"WITH {PX} SELECT image_id, y, x, v FROM px")
def _(spark, d):
    return pixel_rows(planes(spark, d))


@query(
    "frame_axis_indices",
    f"""WITH {FRAMES} SELECT image_id, frame_index,
      CASE WHEN stack_id % 2 = 0 THEN CAST(frame_index % 2 AS INTEGER) END AS c_index,
      CAST(CASE WHEN stack_id % 2 = 0 THEN (frame_index // 2) % 5 ELSE frame_index END AS INTEGER) AS z_index,
      CASE WHEN stack_id % 2 = 0 THEN CAST(frame_index // 10 AS INTEGER) END AS t_index
      FROM frames""",
)
def _(spark, d):
    return sources.frame_axis_indices(
        framed_planes(spark, d), "frame_index", F.lit(5), F.lit(2), F.col("stack_id") % 2 == 0
    ).select("image_id", "frame_index", "c_index", "z_index", "t_index")


@query(
    "select_plane",
    f"WITH {FRAMES} SELECT stack_id, image_id, frame_index FROM frames WHERE frame_index = 3",
)
def _(spark, d):
    return sources.select_plane(framed_planes(spark, d), 3).select(
        "stack_id", "image_id", "frame_index"
    )


@query(
    "folder_as_stack",
    """WITH f AS (
      SELECT label AS stack_id, vec_id AS image_id,
        '/data/' || label || '/' || (vec_id % 3) || '/img_' || (vec_id // 2) || '.tif' AS source_path,
        'img_' || (vec_id // 2) || '.tif' AS name FROM embeddings),
      u AS (SELECT stack_id, name, min(source_path) AS source_path FROM f GROUP BY 1, 2)
      SELECT f.stack_id, u.source_path, f.image_id,
        CAST(row_number() OVER (PARTITION BY u.stack_id ORDER BY u.source_path) - 1 AS INTEGER) AS frame_index,
        CAST(row_number() OVER (PARTITION BY u.stack_id ORDER BY u.source_path) - 1 AS INTEGER) AS z_index,
        0 AS t_index, 0 AS c_index
      FROM u JOIN f ON f.stack_id = u.stack_id AND f.source_path = u.source_path""",
)
def _(spark, d):
    path = F.format_string(
        "/data/%d/%d/img_%d.tif", "stack_id", F.col("image_id") % 3, F.floor(F.col("image_id") / 2)
    )
    return sources.folder_as_stack(planes(spark, d).withColumn("source_path", path)).select(
        "stack_id", "source_path", "image_id", "frame_index", "z_index", "t_index", "c_index"
    )


@query(
    "stack_summary",
    """SELECT label AS stack_id, count(*) AS frame_count, 8 AS height, 8 AS width
       FROM embeddings GROUP BY label""",
)
def _(spark, d):
    return sources.stack_summary(framed_planes(spark, d))


@query(
    "frame_order",
    f"""WITH {FRAMES} SELECT image_id, printf('f%03d', frame_index) AS frame_tag,
      'img_' || image_id || '_' || printf('f%03d', frame_index) AS prefix FROM frames""",
)
def _(spark, d):
    df = framed_planes(spark, d).withColumn(
        "source_path", F.concat(F.lit("/data/img_"), F.col("image_id").cast("string"), F.lit(".tif"))
    )
    return sources.frame_order(df).select("image_id", "frame_tag", "prefix")


@query(
    "write_layer_names",
    f"""WITH {FRAMES} SELECT image_id,
      CASE WHEN image_id % 2 = 0 THEN 'img_' || image_id ELSE printf('frame_%03d', frame_index) END
        || printf('_f%03d_mask.tif', frame_index) AS layer_name FROM frames""",
)
def _(spark, d):
    source = F.when(
        F.col("image_id") % 2 == 0, F.concat(F.lit("/d/img_"), F.col("image_id").cast("string"), F.lit(".tif"))
    )
    return framed_planes(spark, d).select(
        "image_id", layers.layer_name(source, F.col("frame_index"), "mask").alias("layer_name")
    )


# --- pixel-wise ------------------------------------------------------------------------------


@query("manual_threshold", f"WITH {PX} SELECT image_id, y, x, v >= 0.05 AS m FROM px")
def _(spark, d):
    return pixel_rows(pixelwise.manual_threshold(planes(spark, d), 0.05), "mask", "m")


@query(
    "normalize_image",
    f"""WITH {PX}, s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1)
      SELECT image_id, y, x,
        round(CASE WHEN lo = hi THEN 0 ELSE (v - lo) / (hi - lo) END, 6) AS v
      FROM px JOIN s USING (image_id)""",
)
def _(spark, d):
    return pixel_rows(pixelwise.normalize_image(planes(spark, d))).withColumn("v", F.round("v", 6))


_PCT = """s AS (SELECT image_id, quantile_cont(v, CAST({lo} AS DOUBLE)) AS lo,
  quantile_cont(v, CAST({hi} AS DOUBLE)) AS hi FROM {src} GROUP BY 1)"""

_DISPLAY = f"""{_PCT.format(lo=0.01, hi=0.99, src='px')},
  disp AS (SELECT image_id, y, x, v, CAST(floor(greatest(least(
      (v - lo) / (CASE WHEN hi <= lo THEN 1.0 ELSE hi - lo END), 1.0), 0.0) * 255) AS INTEGER) AS display
      FROM px JOIN s USING (image_id))"""


@query("normalize_for_display", f"WITH {PX}, {_DISPLAY} SELECT image_id, y, x, display FROM disp")
def _(spark, d):
    return pixel_rows(pixelwise.normalize_for_display(planes(spark, d)), "display", "display")


@query(
    "normalize_robust",
    f"""WITH {PX}, {_PCT.format(lo=0.01, hi=0.995, src='px')}
      SELECT image_id, y, x, round(CASE WHEN hi <= lo THEN 0 ELSE
        greatest(least((v - lo) / (hi - lo), 1.0), 0.0) END, 6) AS v FROM px JOIN s USING (image_id)""",
)
def _(spark, d):
    return pixel_rows(pixelwise.normalize_robust(planes(spark, d))).withColumn("v", F.round("v", 6))


# four value ranges and dtypes, chosen by the image id, reach every branch of the rule
_U16_CASES = """cases AS (
  SELECT image_id, y, x, image_id % 6 AS k,
    CASE image_id % 6 WHEN 0 THEN 'float64' WHEN 1 THEN 'float32' WHEN 2 THEN 'float64'
      WHEN 3 THEN 'int32' WHEN 4 THEN 'int32' ELSE 'uint8' END AS dtype,
    CASE image_id % 6 WHEN 0 THEN v WHEN 1 THEN v * 5000.5 WHEN 2 THEN v * 400000.0
      WHEN 3 THEN floor(v * 1000) WHEN 4 THEN floor(v * 500000) ELSE floor((v + 1) * 100) END AS v
  FROM px)"""


def _u16_cases(spark, d):
    k = F.col("image_id") % 6

    def value(v):
        return (
            F.when(k == 0, v)
            .when(k == 1, v * 5000.5)
            .when(k == 2, v * 400000.0)
            .when(k == 3, F.floor(v * 1000).cast("double"))
            .when(k == 4, F.floor(v * 500000).cast("double"))
            .otherwise(F.floor((v + 1) * 100).cast("double"))
        )

    kinds = ["float64", "float32", "float64", "int32", "int32", "uint8"]
    return planes(spark, d).withColumns(
        {
            "pixels": F.transform("pixels", value),
            "dtype": F.element_at(F.array(*[F.lit(x) for x in kinds]), (k + 1).cast("int")),
        }
    )


_U16 = f"""{_U16_CASES},
  rng AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM cases GROUP BY 1),
  ruled AS (SELECT c.*, lo, greatest(hi, 0) AS peak, CASE
      WHEN dtype = 'uint8' THEN 'uint8_promoted_to_uint16'
      WHEN dtype LIKE 'float%' THEN CASE WHEN greatest(hi, 0) <= 1 THEN 'float01_scaled_to_uint16'
        WHEN greatest(hi, 0) <= 65535 THEN 'float_intensity_clipped_to_uint16'
        ELSE 'float_intensity_scaled_to_uint16' END
      WHEN hi <= 65535 AND lo >= 0 THEN 'integer_cast_to_uint16'
      WHEN greatest(hi, 0) <= 65535 THEN 'integer_clipped_to_uint16'
      ELSE 'integer_scaled_to_uint16' END AS action
    FROM cases c JOIN rng USING (image_id)),
  u16 AS (SELECT image_id, y, x, dtype, v AS v_before, action, CASE
      WHEN action = 'float01_scaled_to_uint16' THEN floor(greatest(v, 0) * 65535)
      WHEN action = 'float_intensity_clipped_to_uint16' THEN
        CASE WHEN abs(greatest(v, 0) % 1 - 0.5) = 0 THEN 2 * round(greatest(v, 0) / 2) ELSE round(greatest(v, 0)) END
      WHEN action LIKE '%_scaled_to_uint16' THEN floor(least(greatest(v, 0) * (65535.0::DOUBLE / peak), 65535))
      WHEN action = 'integer_clipped_to_uint16' THEN greatest(v, 0) ELSE v END AS v FROM ruled)"""


@query("to_uint16", f"WITH {PX}, {_U16} SELECT image_id, y, x, action, CAST(v AS DOUBLE) AS v FROM u16")
def _(spark, d):
    out = pixelwise.to_uint16(_u16_cases(spark, d)).select("image_id", "width", "action", "pixels")
    return sources.explode_pixels(out).select("image_id", "y", "x", "action", "v")


@query(
    "encode_mask",
    f"WITH {PX} SELECT image_id, y, x, CAST(CASE WHEN v >= 0 THEN 255 ELSE 0 END AS DOUBLE) AS v FROM px",
)
def _(spark, d):
    return pixel_rows(pixelwise.encode_mask(pixelwise.manual_threshold(planes(spark, d), 0.0)))


@query(
    "label_dtype",
    """SELECT l_suppkey AS image_id, CASE WHEN max(l_partkey * 300) <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype
       FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    labels = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 300).alias("label")
    )
    return labels.groupBy("image_id").agg(pixelwise.label_dtype(F.max("label")).alias("dtype"))


@query(
    "encode_intensity",
    f"""WITH {PX} SELECT image_id, y, x, CASE WHEN image_id % 2 = 0 THEN 'float32' ELSE 'uint16' END AS dtype,
      round(CASE WHEN image_id % 2 = 0 THEN CAST(CAST(v / 3 AS FLOAT) AS DOUBLE) ELSE v / 3 END, 6) AS v FROM px""",
)
def _(spark, d):
    df = planes(spark, d).withColumns(
        {
            "pixels": F.transform("pixels", lambda v: v / 3),
            "dtype": F.when(F.col("image_id") % 2 == 0, "float64").otherwise("uint16"),
        }
    )
    out = pixelwise.encode_intensity(df).select("image_id", "width", "dtype", "pixels")
    return sources.explode_pixels(out).select("image_id", "y", "x", "dtype", F.round("v", 6).alias("v"))


@query(
    "normalize_method",
    """WITH m AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' Max Intensity ' WHEN 1 THEN 'AVG'
        WHEN 2 THEN 'std' WHEN 3 THEN 'standard-deviation' WHEN 4 THEN '' WHEN 5 THEN NULL
        WHEN 6 THEN 'Sum' WHEN 7 THEN 'median' ELSE event_type END AS name FROM events),
      s AS (SELECT event_id, name, regexp_replace(lower(trim(name)), '[ -]', '_', 'g') AS slug FROM m)
      SELECT event_id, CASE WHEN name IS NULL OR trim(name) = '' THEN 'max'
        WHEN slug IN ('avg', 'mean') THEN 'average' WHEN slug IN ('maximum', 'max_intensity') THEN 'max'
        WHEN slug IN ('minimum', 'min_intensity') THEN 'min'
        WHEN slug IN ('std', 'stdev', 'standard_deviation') THEN 'standard'
        WHEN slug IN ('average', 'max', 'min', 'sum', 'standard', 'median') THEN slug END AS method FROM s""",
)
def _(spark, d):
    spelled = [" Max Intensity ", "AVG", "std", "standard-deviation", "", None, "Sum", "median"]
    k = F.col("event_id") % 9
    name = F.when(k == 8, F.col("event_type")).otherwise(
        F.get(F.array(*[F.lit(s) for s in spelled]), k.cast("int"))
    )
    return table(spark, d, "events").select(
        "event_id", names.normalize_method(name, on_error="null").alias("method")
    )


@query(
    "projected_name",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/in/Img ' || o_orderkey || '.OIR'
        WHEN 1 THEN '/in/sub.d/img_' || o_orderkey || '.oir' WHEN 2 THEN 'img.' || o_orderkey || '.czi'
        ELSE '/in/plain_' || o_orderkey END AS path FROM orders)
      SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/out/Img ' || o_orderkey || '.tif'
        WHEN 1 THEN '/out/img_' || o_orderkey || '.tif' WHEN 2 THEN '/out/img.' || o_orderkey || '.tif'
        ELSE '/out/plain_' || o_orderkey || '.tif' END AS output_path FROM p""",
)
def _(spark, d):
    key = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 4
    path = (
        F.when(k == 0, F.concat(F.lit("/in/Img "), key, F.lit(".OIR")))
        .when(k == 1, F.concat(F.lit("/in/sub.d/img_"), key, F.lit(".oir")))
        .when(k == 2, F.concat(F.lit("img."), key, F.lit(".czi")))
        .otherwise(F.concat(F.lit("/in/plain_"), key))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", names.projected_path(path, F.lit("/out/")).alias("output_path")
    )


@query(
    "is_under_dir",
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS inside FROM orders""",
)
def _(spark, d):
    k = F.col("o_orderkey") % 3
    path = F.concat(
        F.when(k == 0, "/r/oir_projection/").when(k == 1, "/r/oir_projection/sub/").otherwise("/r/"),
        F.col("o_orderkey").cast("string"),
        F.lit(".tif"),
    )
    return table(spark, d, "orders").select(
        "o_orderkey", names.is_under_dir(path, "oir_projection").alias("inside")
    )


@query(
    "mask_overlay",
    f"""WITH {PX}, {_DISPLAY} SELECT image_id, y, x,
      CAST(CASE WHEN v >= 0 THEN floor(least(display * 0.6::DOUBLE + 0.4::DOUBLE * 255, 255.0)) ELSE display END AS INTEGER) AS r,
      CAST(CASE WHEN v >= 0 THEN floor(display * 0.6::DOUBLE) ELSE display END AS INTEGER) AS g,
      CAST(CASE WHEN v >= 0 THEN floor(display * 0.6::DOUBLE) ELSE display END AS INTEGER) AS b FROM disp""",
)
def _(spark, d):
    out = pixelwise.mask_overlay(pixelwise.manual_threshold(planes(spark, d), 0.0))
    return sources.explode_pixels(
        out.select("image_id", "width", "overlay_r", "overlay_g", "overlay_b"),
        r="overlay_r",
        g="overlay_g",
        b="overlay_b",
    ).select("image_id", "y", "x", "r", "g", "b")


@query(
    "pixel_calibration",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      CASE WHEN l_returnflag <> 'N' THEN round(1 / l_quantity, 9) END AS resolution_x,
      CASE WHEN l_returnflag <> 'N' THEN round(1 / (l_tax + 1), 9) END AS resolution_y FROM lineitem""",
)
def _(spark, d):
    size = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    c = pixelwise.pixel_calibration(size, F.col("l_tax") + 1)
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.round(c["resolution_x"], 9).alias("resolution_x"),
        F.round(c["resolution_y"], 9).alias("resolution_y"),
    )


@query(
    "calibrated_measurements",
    """SELECT l_orderkey AS image_id, l_partkey AS label, l_suppkey, l_linenumber, l_quantity AS area, l_extendedprice,
      round(l_quantity * (o_totalprice / 1000000 + 1) * 0.5, 10) AS area_physical,
      CASE WHEN o_orderkey IS NOT NULL THEN round(l_discount * 0.5, 10) END AS centroid_0_physical,
      round(l_tax * (o_totalprice / 1000000 + 1), 11) AS centroid_1_physical
      FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'""",
)
def _(spark, d):
    objects = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_partkey").alias("label"),
        "l_suppkey",
        "l_linenumber",
        F.col("l_quantity").alias("area"),
        "l_extendedprice",
        F.col("l_discount").alias("centroid_0"),
        F.col("l_tax").alias("centroid_1"),
    )
    sizes = (
        table(spark, d, "orders")
        .filter("o_orderstatus <> 'P'")
        .select(
            F.col("o_orderkey").alias("image_id"),
            (F.col("o_totalprice") / 1000000 + 1).alias("pixel_size_x"),
            F.lit(0.5).alias("pixel_size_y"),
        )
    )
    done = pixelwise.calibrated_measurements(objects, sizes)
    physical = {"area_physical": 10, "centroid_0_physical": 10, "centroid_1_physical": 11}
    return done.select(
        "image_id", "label", "l_suppkey", "l_linenumber", "area", "l_extendedprice",
        *[F.round(c, n).alias(c) for c, n in physical.items()],
    )


# --- stencils --------------------------------------------------------------------------------


@query(
    "gaussian_blur",
    f"WITH {PX}, {blur_sql('px', 'b')} SELECT image_id, y, x, round(v, 6) AS v FROM b",
)
def _(spark, d):
    return pixel_rows(stencil.gaussian_blur(planes(spark, d), 1.0)).withColumn("v", F.round("v", 6))


@query(
    "median_filter",
    f"""WITH {PX}, o AS (SELECT unnest([-1, 0, 1]) AS k)
      SELECT p.image_id, p.y, p.x, round(median(q.v), 6) AS v
      FROM px p, o a, o b JOIN px q ON q.image_id = p.image_id
        AND q.y = least(greatest(p.y + a.k, 0), 7) AND q.x = least(greatest(p.x + b.k, 0), 7)
      GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return pixel_rows(stencil.median_filter(planes(spark, d), 1)).withColumn("v", F.round("v", 6))


_DISK2 = """disk AS (SELECT a.k AS dy, b.k AS dx FROM range(-2, 3) AS a(k), range(-2, 3) AS b(k)
  WHERE a.k * a.k + b.k * b.k <= 4)"""


def _morph(source: str, name: str, agg: str) -> str:
    def fold(e):
        return f"(CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} > 7 THEN 15 - ({e}) ELSE {e} END)"

    return f"""{name} AS (SELECT p.image_id, p.y, p.x, {agg}(q.v) AS v FROM px p, disk JOIN {source} q
      ON q.image_id = p.image_id AND q.y = {fold('p.y + dy')} AND q.x = {fold('p.x + dx')} GROUP BY 1, 2, 3)"""


@query(
    "rolling_ball_subtract",
    f"""WITH {PX}, {_DISK2}, {_morph('px', 'ero', 'min')}, {_morph('ero', 'bg', 'max')}
      SELECT px.image_id, px.y, px.x, round(greatest(px.v - bg.v, 0), 6) AS v
      FROM px JOIN bg USING (image_id, y, x)""",
)
def _(spark, d):
    return pixel_rows(stencil.rolling_ball_subtract(planes(spark, d), 2)).withColumn(
        "v", F.round("v", 6)
    )


def _cross(source: str, name: str, agg: str) -> str:
    return f"""{name} AS (SELECT p.image_id, p.y, p.x, {agg}(q.m) AS m FROM {source} p JOIN {source} q
      ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3)"""


@query(
    "binary_opening",
    f"""WITH {PX}, mk AS (SELECT image_id, y, x, v >= -0.05 AS m FROM px),
      {_cross('mk', 'ero', 'bool_and')}, {_cross('ero', 'dil', 'bool_or')}
      SELECT image_id, y, x, m FROM dil""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(planes(spark, d), -0.05)
    return pixel_rows(stencil.binary_opening(masked), "mask", "m")


@query(
    "adaptive_threshold",
    f"""WITH {PX}, {blur_sql('px', 'b', (5 - 1) / 6.0)}
      SELECT image_id, y, x, px.v > b.v - 0.01 AS m FROM px JOIN b USING (image_id, y, x)""",
)
def _(spark, d):
    return pixel_rows(stencil.adaptive_threshold(planes(spark, d), 5, 0.01), "mask", "m")


@query(
    "sauvola_threshold",
    f"""WITH {PX}, o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k),
      mx AS (SELECT image_id, CASE WHEN max(v) <= 0 THEN 1.0 ELSE max(v) END AS r FROM px GROUP BY 1),
      w AS (SELECT p.image_id, p.y, p.x, any_value(p.v) AS v, avg(q.v) AS m,
          sqrt(greatest(sum(q.v * q.v) / 25 - (sum(q.v) / 25) * (sum(q.v) / 25), 0)) AS s
        FROM px p, o a, o b JOIN px q ON q.image_id = p.image_id
          AND q.y = (CASE WHEN p.y + a.k < 0 THEN -(p.y + a.k) WHEN p.y + a.k > 7 THEN 14 - (p.y + a.k) ELSE p.y + a.k END)
          AND q.x = (CASE WHEN p.x + b.k < 0 THEN -(p.x + b.k) WHEN p.x + b.k > 7 THEN 14 - (p.x + b.k) ELSE p.x + b.k END)
        GROUP BY 1, 2, 3)
      SELECT image_id, y, x, v > m * (1 + 0.2::DOUBLE * (s / r - 1)) AS m FROM w JOIN mx USING (image_id)""",
)
def _(spark, d):
    return pixel_rows(stencil.sauvola_threshold(planes(spark, d), 5), "mask", "m")


@query(
    "integral_image",
    f"""WITH {PX} SELECT image_id, y, x, round(sum(s) OVER (PARTITION BY image_id, x ORDER BY y), 6) AS integral
      FROM (SELECT image_id, y, x, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM px)""",
)
def _(spark, d):
    return pixel_rows(stencil.integral_image(planes(spark, d)), "integral", "integral").withColumn(
        "integral", F.round("integral", 6)
    )


# Larger planes, and blocks of 31: mirrored lines first, then mirrored columns.
@query(
    "sauvola_threshold_sheets",
    f"""WITH {SHEETS}, o AS (SELECT unnest(range(-15, 16)) AS k),
      size AS (SELECT image_id, max(y) AS last, CASE WHEN max(v) <= 0 THEN 1.0 ELSE max(v) END AS r FROM px GROUP BY 1),
      down AS (SELECT p.image_id, p.y, q.x, sum(q.v) AS s1, sum(q.v * q.v) AS s2
        FROM (SELECT DISTINCT image_id, y, last FROM px JOIN size USING (image_id)) p, o JOIN px q ON q.image_id = p.image_id
          AND q.y = (CASE WHEN p.y + k < 0 THEN -(p.y + k) WHEN p.y + k > last THEN 2 * last - (p.y + k) ELSE p.y + k END)
        GROUP BY 1, 2, 3),
      w AS (SELECT p.image_id, p.y, p.x, any_value(p.v) AS v, sum(s1) / 961 AS m, sum(s2) / 961 AS m2
        FROM px p, o JOIN down q ON q.image_id = p.image_id AND q.y = p.y
          AND q.x = (CASE WHEN p.x + k < 0 THEN -(p.x + k) WHEN p.x + k > 63 THEN 126 - (p.x + k) ELSE p.x + k END)
        GROUP BY 1, 2, 3)
      SELECT image_id, y, x, v > m * (1 + 0.2::DOUBLE * (sqrt(greatest(m2 - m * m, 0)) / r - 1)) AS m
      FROM w JOIN size USING (image_id)""",
)
def _(spark, d):
    return pixel_rows(stencil.sauvola_threshold(sheets(spark, d), 31), "mask", "m")


@query(
    "integral_image_sheets",
    f"""WITH {SHEETS} SELECT image_id, y, x, round(sum(s) OVER (PARTITION BY image_id, x ORDER BY y), 6) AS integral
      FROM (SELECT image_id, y, x, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS s FROM px)""",
)
def _(spark, d):
    return pixel_rows(stencil.integral_image(sheets(spark, d)), "integral", "integral").withColumn(
        "integral", F.round("integral", 6)
    )


# --- histogram thresholds --------------------------------------------------------------------


@query(
    "intensity_histogram",
    f"WITH {PX}, {otsu_sql('px', 'o')} SELECT image_id, CAST(bin AS BIGINT) AS bin, round(c, 6) AS center, n FROM o_cen",
)
def _(spark, d):
    return histogram.intensity_histogram(planes(spark, d)).withColumn("center", F.round("center", 6))


@query(
    "intensity_histogram_int",
    f"""WITH {IPX}, r AS (SELECT image_id, min(v) AS lo FROM ipx GROUP BY 1)
      SELECT image_id, CAST(v - lo AS BIGINT) AS bin, v AS center, count(*) AS n
      FROM ipx JOIN r USING (image_id) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return histogram.intensity_histogram(int_planes(spark, d))


@query("otsu_value", f"WITH {PX}, {otsu_sql('px', 'o')} SELECT image_id, round(t, 6) AS threshold FROM o")
def _(spark, d):
    return histogram.otsu_value(planes(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query(
    "otsu_threshold",
    f"WITH {PX}, {otsu_sql('px', 'o')} SELECT image_id, y, x, v > t AS m FROM px JOIN o USING (image_id)",
)
def _(spark, d):
    return pixel_rows(histogram.otsu_threshold(planes(spark, d)), "mask", "m")


@query(
    "intensity_histogram_sheets",
    f"WITH {SHEETS}, {otsu_sql('px', 'o')} SELECT image_id, CAST(bin AS BIGINT) AS bin, round(c, 6) AS center, n FROM o_cen",
)
def _(spark, d):
    return histogram.intensity_histogram(sheets(spark, d)).withColumn("center", F.round("center", 6))


@query(
    "otsu_threshold_sheets",
    f"WITH {SHEETS}, {otsu_sql('px', 'o')} SELECT image_id, y, x, v > t AS m FROM px JOIN o USING (image_id)",
)
def _(spark, d):
    return pixel_rows(histogram.otsu_threshold(sheets(spark, d)), "mask", "m")


# --- projections -----------------------------------------------------------------------------

_SQL_AGG = {
    "average": "avg(v)",
    "max": "max(v)",
    "min": "min(v)",
    "sum": "sum(v)",
    "standard": "stddev_pop(v)",
    "median": "median(v)",
}


def _projection(method):
    @query(
        f"z_project_{method}",
        f"WITH {PX} SELECT stack_id, y, x, round({_SQL_AGG[method]}, 6) AS v FROM px GROUP BY 1, 2, 3",
    )
    def run(spark, d):
        return measure.z_project(planes(spark, d), method).withColumn("v", F.round("v", 6))


for _method in _SQL_AGG:
    _projection(_method)


@query(
    "z_project_channels",
    f"""WITH {PX} SELECT stack_id, CAST(image_id % 3 AS INTEGER) AS t_index, CAST(image_id % 2 AS INTEGER) AS c_index, y, x,
      round(median(v), 6) AS v FROM px GROUP BY ALL""",
)
def _(spark, d):
    several = planes(spark, d).withColumns(
        {"t_index": (F.col("image_id") % 3).cast("int"), "c_index": (F.col("image_id") % 2).cast("int")}
    )
    return measure.z_project(several, "median").withColumn("v", F.round("v", 6))


# --- statistics ------------------------------------------------------------------------------

_INSPECT = """st AS (SELECT image_id, min(v) AS min_value, max(v) AS max_value, avg(v) AS mean_intensity,
    quantile_cont(v, 0.25::DOUBLE) AS p25, quantile_cont(v, 0.3::DOUBLE) AS p30,
    quantile_cont(v, 0.5::DOUBLE) AS p50, quantile_cont(v, 0.9::DOUBLE) AS p90 FROM {src} GROUP BY 1),
  bg AS (SELECT image_id, stddev_pop(v) FILTER (v <= p25) AS bg25, stddev_pop(v) FILTER (v <= p30) AS bg30
    FROM {src} JOIN st USING (image_id) GROUP BY 1),
  ins AS (SELECT st.*, bg25, bg30, CASE WHEN bg25 > 0 THEN (p90 - p50) / bg25 END AS snr FROM st JOIN bg USING (image_id))"""


@query(
    "inspect_image",
    f"""WITH {IPX}, {_INSPECT.format(src='ipx')}
      SELECT image_id, min_value, max_value, max_value - min_value AS dynamic_range,
        round(mean_intensity, 6) AS mean_intensity, round(bg25, 6) AS background_std, round(snr, 6) AS estimated_snr,
        concat_ws('|', CASE WHEN snr < 3 THEN 'Low estimated SNR: thresholding may be unstable.' END,
          CASE WHEN max_value - min_value < 100 THEN 'Low dynamic range: weak foreground/background separation.' END) AS limitations
      FROM ins""",
)
def _(spark, d):
    return stats.inspect_image(int_planes(spark, d)).select(
        "image_id",
        "min_value",
        "max_value",
        "dynamic_range",
        *[F.round(c, 6).alias(c) for c in ("mean_intensity", "background_std", "estimated_snr")],
        F.array_join("limitations", "|").alias("limitations"),
    )


_VIGNETTE = """vg AS (SELECT image_id, sum(v * wt) / sum(wt) AS corner, median(v) AS fm FROM (
    SELECT image_id, v, ((y < 4)::INT + (y >= 4)::INT) * ((x < 4)::INT + (x >= 4)::INT) AS wt FROM {src}) GROUP BY 1),
  vs AS (SELECT image_id, CASE WHEN fm <= 0 OR corner >= fm * 0.95::DOUBLE THEN 0.0 ELSE (fm - corner) / fm END AS vignette FROM vg)"""


@query(
    "vignette_score",
    f"""WITH {PX}, {_VIGNETTE.format(src='px')} SELECT image_id, round(vignette, 6) AS vignette_score FROM vs""",
)
def _(spark, d):
    return stats.vignette_score(planes(spark, d)).withColumn(
        "vignette_score", F.round("vignette_score", 6)
    )


@query(
    "estimate_offset",
    f"WITH {PX}, {_INSPECT.format(src='px')} SELECT image_id, round(greatest(bg30 * 0.25::DOUBLE, 0), 6) AS \"offset\" FROM ins",
)
def _(spark, d):
    return stats.estimate_offset(planes(spark, d)).withColumn("offset", F.round("offset", 6))


@query(
    "mask_sanity",
    f"""WITH {PX}, f AS (SELECT image_id, avg((v >= 0.15)::INT) AS foreground_fraction FROM px GROUP BY 1)
      SELECT image_id, foreground_fraction, foreground_fraction > 0.0005 AND foreground_fraction < 0.55 AS sane,
        CASE WHEN foreground_fraction <= 0.0005 THEN 'Threshold produced almost no foreground.'
          WHEN foreground_fraction >= 0.55 THEN 'Threshold produced excessive foreground.' END AS warning FROM f""",
)
def _(spark, d):
    return stats.mask_sanity(pixelwise.manual_threshold(planes(spark, d), 0.15))


_METHOD = """CASE WHEN snr < 3 THEN 'sauvola' WHEN vignette < 0.05 AND (snr IS NULL OR snr >= 4) THEN 'otsu'
  WHEN snr >= 6 AND vignette < 0.12 THEN 'otsu' ELSE 'local' END"""


@query(
    "choose_method",
    f"""WITH {PX}, {_INSPECT.format(src='px')}, {_VIGNETTE.format(src='px')}
      SELECT image_id, {_METHOD} AS method FROM ins JOIN vs USING (image_id)""",
)
def _(spark, d):
    df = planes(spark, d)
    snr = stats.inspect_image(df).select("image_id", "estimated_snr")
    return snr.join(stats.vignette_score(df), "image_id").select(
        "image_id",
        stats.choose_method(F.col("estimated_snr"), F.col("vignette_score")).alias("method"),
    )


@query(
    "score_confidence",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_type = 'error' THEN 'low'
        WHEN event_type = 'click' OR value / 20 < 3 THEN 'medium'
        WHEN value / 20 >= 5 AND event_type <> 'view' THEN 'high' ELSE 'medium' END AS confidence FROM events""",
)
def _(spark, d):
    kind = F.col("event_type")
    warnings = (
        F.when(kind == "error", F.array(F.lit("Threshold produced almost no foreground.")))
        .when(kind == "view", F.array(F.lit("Low dynamic range: weak foreground/background separation.")))
        .otherwise(F.array().cast("array<string>"))
    )
    return table(spark, d, "events").select(
        "event_id",
        stats.score_confidence(
            F.col("value") / 20, warnings, kind == "click", F.col("event_id") % 5
        ).alias("confidence"),
    )


@query(
    "describe_projected",
    f"""WITH {IPX} SELECT image_id, 8 AS height, 8 AS width, 'uint16' AS dtype, min(v) AS min, max(v) AS max,
      count(*) FILTER (v <> 0) AS nonzero, 1 AS channel_count FROM ipx GROUP BY image_id""",
)
def _(spark, d):
    return stats.describe_projected(int_planes(spark, d))


@query(
    "postprocess_projected",
    f"""WITH {PX}, {_U16} SELECT image_id, dtype AS dtype_before, any_value(action) AS action,
      min(v_before) AS min_before, max(v_before) AS max_before, count(*) FILTER (v_before <> 0) AS nonzero_before,
      'uint16' AS dtype_after, CAST(min(v) AS DOUBLE) AS min_after, CAST(max(v) AS DOUBLE) AS max_after,
      count(*) FILTER (v <> 0) AS nonzero_after, true AS rewritten FROM u16 GROUP BY 1, 2""",
)
def _(spark, d):
    return stats.postprocess_projected(_u16_cases(spark, d), "python").select(
        "image_id", "dtype_before", "action", "min_before", "max_before", "nonzero_before",
        "dtype_after", "min_after", "max_after", "nonzero_after", "rewritten",
    )


# Both engines over planes that are 16-bit already and planes that have to be clipped.
@query(
    "postprocess_projected_engines",
    f"""WITH {IPX}, src AS (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'uint16' ELSE 'int32' END AS dtype,
        CASE WHEN image_id % 2 = 0 THEN v ELSE v - 1000 END AS v FROM ipx),
      run AS (SELECT engine, image_id, dtype, v, CASE WHEN engine = 'python' THEN least(greatest(v, 0), 65535) ELSE v END AS w
        FROM src, (SELECT unnest(['python', 'fiji']) AS engine))
      SELECT image_id, engine, dtype AS dtype_before, CASE WHEN engine = 'fiji' THEN 'fiji_preserved'
          WHEN dtype = 'uint16' THEN 'unchanged_uint16' ELSE 'integer_clipped_to_uint16' END AS action,
        min(v) AS min_before, max(v) AS max_before, CASE WHEN engine = 'fiji' THEN dtype ELSE 'uint16' END AS dtype_after,
        min(w) AS min_after, max(w) AS max_after, count(*) FILTER (w <> 0) AS nonzero_after,
        engine = 'python' AND dtype = 'int32' AS rewritten FROM run GROUP BY ALL""",
)
def _(spark, d):
    even = F.col("image_id") % 2 == 0
    source = int_planes(spark, d).withColumns(
        {
            "dtype": F.when(even, "uint16").otherwise("int32"),
            "pixels": F.when(even, F.col("pixels")).otherwise(F.transform("pixels", lambda v: v - 1000)),
        }
    )
    both = [stats.postprocess_projected(source, engine) for engine in ("python", "fiji")]
    return both[0].unionByName(both[1]).select(
        "image_id", "engine", "dtype_before", "action", "min_before", "max_before", "dtype_after", "min_after", "max_after",
        "nonzero_after", "rewritten",
    )


_KIND_NAMES = """kn AS (SELECT image_id, y, x, CASE image_id % 7 WHEN 0 THEN 'DNA_mask.tif' WHEN 1 THEN 'labeled_mask.tif'
    WHEN 2 THEN 'Cells_objects.tif' ELSE 'img.tif' END AS filename,
    CASE WHEN image_id % 7 IN (3, 4) THEN 'uint16' ELSE 'float64' END AS dtype,
    CASE WHEN image_id % 7 = 3 THEN CASE WHEN v >= 0 THEN 255.0 ELSE 0.0 END
         WHEN image_id % 7 = 4 THEN floor((v + 1) * 3) ELSE v END AS v FROM px)"""


@query(
    "classify_layer",
    f"""WITH {PX}, {_KIND_NAMES} SELECT image_id, CASE
        WHEN any_value(filename) LIKE '%mask%' AND any_value(filename) NOT LIKE '%labeled%' THEN 'mask'
        WHEN regexp_matches(any_value(filename), 'label|objects|segmented') THEN 'label'
        WHEN count(DISTINCT v) <= 3 AND bool_and(v IN (0, 1, 255)) THEN 'mask'
        WHEN any_value(dtype) LIKE 'uint%' AND count(DISTINCT v) > 2 AND max(v) > 1 THEN 'label'
        ELSE 'intensity' END AS kind FROM kn GROUP BY image_id""",
)
def _(spark, d):
    k = F.col("image_id") % 7
    df = planes(spark, d).withColumns(
        {
            "filename": F.when(k == 0, "DNA_mask.tif").when(k == 1, "labeled_mask.tif").when(k == 2, "Cells_objects.tif").otherwise("img.tif"),
            "dtype": F.when(k.isin(3, 4), "uint16").otherwise("float64"),
            "pixels": F.transform(
                "pixels",
                lambda v: F.when(k == 3, F.when(v >= 0, 255.0).otherwise(0.0))
                .when(k == 4, F.floor((v + 1) * 3).cast("double"))
                .otherwise(v),
            ),
        }
    )
    return layers.classify_layer(df).select("image_id", "kind")


@query(
    "compare_projected",
    f"""WITH {PX}, c AS (SELECT image_id, y, x, v AS a, CASE WHEN image_id % 3 = 0 THEN v ELSE round(v, 2) END AS b FROM px)
      SELECT image_id, round(min(a), 6) AS reference_min, round(min(b), 6) AS candidate_min,
        count(*) FILTER (a <> 0) AS reference_nonzero, count(*) FILTER (b <> 0) AS candidate_nonzero,
        round(max(abs(b - a)), 6) AS max_abs_diff, round(avg(abs(b - a)), 6) AS mean_abs_diff,
        bool_and(a = b) AS identical FROM c GROUP BY 1""",
)
def _(spark, d):
    df = planes(spark, d)
    rounded = df.withColumn(
        "pixels",
        F.transform("pixels", lambda v: F.when(F.col("image_id") % 3 == 0, v).otherwise(F.round(v, 2))),
    )
    return compare.compare_projected(df, rounded).select(
        "image_id",
        F.round("reference_min", 6).alias("reference_min"),
        F.round("candidate_min", 6).alias("candidate_min"),
        "reference_nonzero",
        "candidate_nonzero",
        F.round("max_abs_diff", 6).alias("max_abs_diff"),
        F.round("mean_abs_diff", 6).alias("mean_abs_diff"),
        "identical",
    )


@query(
    "pixel_layers",
    f"""WITH {PX}, {otsu_sql('px', 'o')} SELECT image_id, y, x, v, v > t AS m FROM px JOIN o USING (image_id)""",
)
def _(spark, d):
    df = planes(spark, d)
    masks = histogram.otsu_threshold(df).select("image_id", "mask")
    aligned = pixelwise.pixel_layers(df.select("image_id", "width", "pixels"), masks)
    return sources.explode_pixels(aligned, v="pixels", m="mask").select("image_id", "y", "x", "v", "m")
