"""Checked queries on one plane that grows with the table and is stored in bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.operators import bands, pixelwise, regions
from pixelframe.sources.planes import explode_pixels
from registry import query
from registry.inputs import long_plane, long_sql, otsu_sql
from registry.regions import INTENSITY, MEASURE, rounded_objects


LONG = long_sql()
# Squares of what exceeds 0.1: bright spots on a dark ground, so objects stay apart.
SPOTS = long_sql("greatest(e - 0.1::DOUBLE, 0) * greatest(e - 0.1::DOUBLE, 0)")


def band_pixels(df, array="pixels", name="v"):
    """Pixels with the lines of the plane."""
    rows = explode_pixels(df.select("image_id", "y0", "width", array), **{name: array})
    return rows.select("image_id", (F.col("y") + F.col("y0")).alias("y"), "x", name)


# --- SQL twins: neighbours by folded lines and columns --------------------------------------------


def reflected(e: str, last: str) -> str:
    return f"(CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} > {last} THEN 2 * {last} + 1 - ({e}) ELSE {e} END)"


def long_blur(name: str, sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    weight = f"exp(-0.5 * k * k / ({sigma} * {sigma}))"
    return f"""{name}_k AS (SELECT k, {weight} / sum({weight}) OVER () AS w FROM range(-{radius}, {radius} + 1) AS t(k)),
{name}_v AS (SELECT p.image_id, p.y, p.x, sum(w * q.v) AS v FROM px p, dim, {name}_k
  JOIN px q ON q.x = p.x AND q.y = {reflected('p.y + k', 'last')} GROUP BY 1, 2, 3),
{name} AS (SELECT p.image_id, p.y, p.x, sum(w * q.v) AS v FROM px p, {name}_k
  JOIN {name}_v q ON q.y = p.y AND q.x = {reflected('p.x + k', '63')} GROUP BY 1, 2, 3)"""


def long_morph(source: str, name: str, agg: str, radius: int) -> str:
    return f"""{name} AS (SELECT p.image_id, p.y, p.x, {agg}(q.v) AS v
  FROM px p, dim, range(-{radius}, {radius} + 1) AS a(dy), range(-{radius}, {radius} + 1) AS b(dx)
  JOIN {source} q ON q.y = {reflected('p.y + dy', 'last')} AND q.x = {reflected('p.x + dx', '63')}
  WHERE dy * dy + dx * dx <= {radius * radius} GROUP BY 1, 2, 3)"""


def long_cross(source: str, name: str, agg: str) -> str:
    return f"""{name} AS (SELECT p.image_id, p.y, p.x, {agg}(q.m) AS m
  FROM {source} p, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) AS n(dy, dx)
  JOIN {source} q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)"""


def long_components(source: str, name: str, connectivity: int) -> str:
    """Smallest raster position of each pixel's component; neighbours by exact places, so the join stays linear."""
    reach = 2 if connectivity == 8 else 1
    return f"""{name}_n AS (SELECT a.k AS dy, b.k AS dx FROM range(-1, 2) AS a(k), range(-1, 2) AS b(k)
  WHERE abs(a.k) + abs(b.k) BETWEEN 1 AND {reach}),
{name}_r AS (
  SELECT image_id, y, x, CAST(y AS BIGINT) * 64 + x AS root FROM {source}
  UNION
  SELECT q.image_id, q.y, q.x, r.root FROM {name}_r r, {name}_n
  JOIN {source} q ON q.y = r.y + dy AND q.x = r.x + dx WHERE r.root < CAST(q.y AS BIGINT) * 64 + q.x),
{name} AS (SELECT image_id, y, x, min(root) AS root FROM {name}_r GROUP BY 1, 2, 3)"""


@query("gaussian_blur_bands", f"WITH {LONG}, {long_blur('b', 2.0)} SELECT image_id, y, x, round(v, 6) AS v FROM b")
def _(spark, d):
    return band_pixels(bands.gaussian_blur(long_plane(spark, d), 2.0)).withColumn("v", F.round("v", 6))


@query(
    "median_filter_bands",
    f"""WITH {LONG} SELECT p.image_id, p.y, p.x, round(median(q.v), 6) AS v
      FROM px p, dim, range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)
      JOIN px q ON q.y = {reflected('p.y + dy', 'last')} AND q.x = {reflected('p.x + dx', '63')} GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return band_pixels(bands.median_filter(long_plane(spark, d), 2)).withColumn("v", F.round("v", 6))


@query(
    "rolling_ball_subtract_bands",
    f"""WITH {LONG}, {long_morph('px', 'ero', 'min', 5)}, {long_morph('ero', 'bg', 'max', 5)}
      SELECT px.image_id, px.y, px.x, round(greatest(px.v - bg.v, 0), 6) AS v FROM px JOIN bg USING (image_id, y, x)""",
)
def _(spark, d):
    return band_pixels(bands.rolling_ball_subtract(long_plane(spark, d), 5)).withColumn("v", F.round("v", 6))


@query(
    "binary_opening_bands",
    f"""WITH {LONG}, mk AS (SELECT image_id, y, x, v >= -0.1 AS m FROM px),
      {long_cross('mk', 'ero', 'bool_and')}, {long_cross('ero', 'dil', 'bool_or')} SELECT image_id, y, x, m FROM dil""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(long_plane(spark, d), -0.1)
    return band_pixels(bands.binary_opening(masked), "mask", "m")


@query(
    "adaptive_threshold_bands",
    f"""WITH {LONG}, {long_blur('b', (13 - 1) / 6.0)}
      SELECT image_id, y, x, px.v > b.v - 0.01 AS m FROM px JOIN b USING (image_id, y, x)""",
)
def _(spark, d):
    return band_pixels(bands.adaptive_threshold(long_plane(spark, d), 13, 0.01), "mask", "m")


@query(
    "sauvola_threshold_bands",
    f"""WITH {LONG}, o AS (SELECT unnest(range(-15, 16)) AS k),
      top AS (SELECT CASE WHEN max(v) <= 0 THEN 1.0 ELSE max(v) END AS r FROM px),
      down AS (SELECT p.y, q.x, sum(q.v) AS s1, sum(q.v * q.v) AS s2 FROM (SELECT DISTINCT y FROM px) p, dim, o
        JOIN px q ON q.y = (CASE WHEN p.y + k < 0 THEN -(p.y + k) WHEN p.y + k > last THEN 2 * last - (p.y + k) ELSE p.y + k END)
        GROUP BY 1, 2),
      w AS (SELECT p.image_id, p.y, p.x, any_value(p.v) AS v, sum(s1) / 961 AS m, sum(s2) / 961 AS m2 FROM px p, o
        JOIN down q ON q.y = p.y AND q.x = (CASE WHEN p.x + k < 0 THEN -(p.x + k) WHEN p.x + k > 63 THEN 126 - (p.x + k) ELSE p.x + k END)
        GROUP BY 1, 2, 3)
      SELECT image_id, y, x, v > m * (1 + 0.2::DOUBLE * (sqrt(greatest(m2 - m * m, 0)) / r - 1)) AS m FROM w, top""",
)
def _(spark, d):
    return band_pixels(bands.sauvola_threshold(long_plane(spark, d), 31), "mask", "m")


@query(
    "integral_image_bands",
    f"""WITH {LONG} SELECT image_id, y, x, round(sum(s) OVER (PARTITION BY x ORDER BY y), 6) AS integral
      FROM (SELECT image_id, y, x, sum(v) OVER (PARTITION BY y ORDER BY x) AS s FROM px)""",
)
def _(spark, d):
    summed = bands.integral_image(long_plane(spark, d))
    return band_pixels(summed, "integral", "integral").withColumn("integral", F.round("integral", 6))


@query(
    "otsu_threshold_bands",
    f"WITH {LONG}, {otsu_sql('px', 'o')} SELECT image_id, y, x, v > t AS m FROM px JOIN o USING (image_id)",
)
def _(spark, d):
    return band_pixels(bands.otsu_threshold(long_plane(spark, d)), "mask", "m")


@query(
    "label_objects_bands",
    f"""WITH RECURSIVE {LONG}, fg AS (SELECT image_id, y, x FROM px WHERE v >= 0.1), {long_components('fg', 'cc', 8)}
      SELECT px.image_id, px.y, px.x, CAST(coalesce(label, 0) AS INTEGER) AS label
      FROM px LEFT JOIN (SELECT y, x, dense_rank() OVER (ORDER BY root) AS label FROM cc) USING (y, x)""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(long_plane(spark, d), 0.1)
    labels = regions.label_objects(bands.band_runs(masked), 8)
    return band_pixels(bands.paint_labels(masked, labels), "labels", "label")


@query(
    "segment_bands",
    f"""WITH RECURSIVE {SPOTS}, {long_blur('b', 0.5)}, {otsu_sql('b', 'o')},
      fg AS (SELECT image_id, y, x FROM b JOIN o USING (image_id) WHERE v > t), {long_components('fg', 'small', 4)},
      kept AS (SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM small) WHERE n >= 3),
      {long_components('kept', 'cc', 8)},
      lab AS (SELECT image_id, y, x, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM cc)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY image_id, label""",
)
def _(spark, d):
    over = F.transform("pixels", lambda v: F.greatest(v - 0.1, F.lit(0.0)))
    spots = long_plane(spark, d).withColumn("pixels", F.transform(over, lambda v: v * v))
    return rounded_objects(bands.segment_bands(spots, 0.5, 3))
