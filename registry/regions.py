"""Checked queries over regions of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.operators import compare, histogram, measure, pixelwise, regions, stats, watershed
from pixelframe.plans import adaptive, pipeline
import registry
from registry import query
from registry.inputs import FRAMES, IPX, PX, SHEETS, blur_sql, otsu_sql, planes, sheets
from registry.pixels import _DISPLAY as DISPLAY
from registry.pixels import _INSPECT as INSPECT
from registry.pixels import pixel_rows


def otsu_planes(spark, d):
    return histogram.otsu_threshold(planes(spark, d))


def otsu_runs(spark, d):
    return regions.mask_runs(otsu_planes(spark, d))


def fg_pixels(runs):
    return regions.run_pixels(runs.select("image_id", "y", "x0", "x1"))


# --- SQL twins: connected components by recursion ----------------------------------------------

OTSU = otsu_sql("px", "o")
FG = "fg AS (SELECT image_id, y, x FROM px JOIN o USING (image_id) WHERE v > t)"


def cc_sql(source: str, name: str, connectivity: int, width: int = 8) -> str:
    """``name(image_id, y, x, root)``: smallest raster position of each pixel's component."""
    if connectivity == 8:
        near = "abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1"
    else:
        near = "abs(q.y - r.y) + abs(q.x - r.x) <= 1"
    return f"""{name}_r AS (
  SELECT image_id, y, x, y * {width} + x AS root FROM {source}
  UNION
  SELECT q.image_id, q.y, q.x, r.root FROM {name}_r r JOIN {source} q
    ON q.image_id = r.image_id AND r.root < q.y * {width} + q.x AND {near}),
{name} AS (SELECT image_id, y, x, min(root) AS root FROM {name}_r GROUP BY 1, 2, 3)"""


def small_sql(source: str, name: str, size: int) -> str:
    return f"""{cc_sql(source, f'{name}_c', 4)},
{name} AS (SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM {name}_c)
  WHERE n >= {size})"""


def border_sql(source: str, name: str) -> str:
    return f"""{cc_sql(source, f'{name}_c', 8)},
{name} AS (SELECT image_id, y, x FROM (SELECT *, bool_or(y IN (0, 7) OR x IN (0, 7)) OVER (PARTITION BY image_id, root) AS b
  FROM {name}_c) WHERE NOT b)"""


def fill_sql(source: str, name: str) -> str:
    return f"""{name}_bg AS (SELECT image_id, y, x FROM px ANTI JOIN {source} USING (image_id, y, x)),
{cc_sql(f'{name}_bg', f'{name}_c', 4)},
{name} AS (SELECT image_id, y, x FROM {source} UNION ALL
  SELECT image_id, y, x FROM (SELECT *, bool_or(y IN (0, 7) OR x IN (0, 7)) OVER (PARTITION BY image_id, root) AS b
  FROM {name}_c) WHERE NOT b)"""


MEASURE = """CAST(count(*) AS DOUBLE) AS area, round(avg(y), 6) AS centroid_0, round(avg(x), 6) AS centroid_1,
  min(y) AS bbox_0, min(x) AS bbox_1, max(y) + 1 AS bbox_2, max(x) + 1 AS bbox_3"""
INTENSITY = "round(avg(v), 6) AS mean_intensity, round(max(v), 6) AS max_intensity"


def rounded_objects(df):
    doubles = [c for c in df.columns if c.startswith("centroid") or c.endswith("intensity")]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query(
    "mask_runs",
    f"""WITH {PX}, {OTSU}, {FG} SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM (
      SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM fg)
      GROUP BY image_id, y, g""",
)
def _(spark, d):
    return otsu_runs(spark, d).select("image_id", "y", "x0", "x1")


@query(
    "label_objects",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {cc_sql('fg', 'cc', 8)}
      SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc""",
)
def _(spark, d):
    labels = regions.label_objects(otsu_runs(spark, d), 8)
    return regions.run_pixels(labels.select("image_id", "y", "label", "x0", "x1")).select(
        "image_id", "y", "x", "label"
    )


@query(
    "label_objects_sheets",
    f"""WITH RECURSIVE {SHEETS}, fg AS (SELECT image_id, y, x FROM px WHERE v >= 0.1), {cc_sql('fg', 'cc', 8, 64)}
      SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc""",
)
def _(spark, d):
    runs = regions.mask_runs(pixelwise.manual_threshold(sheets(spark, d), 0.1))
    labels = regions.label_objects(runs, 8)
    return regions.run_pixels(labels.select("image_id", "y", "label", "x0", "x1")).select(
        "image_id", "y", "x", "label"
    )


@query(
    "count_objects",
    f"""WITH RECURSIVE {PX}, fg AS (SELECT image_id, y, x FROM px WHERE v >= 0.3), {cc_sql('fg', 'cc', 8)}
      SELECT vec_id AS image_id, (SELECT count(DISTINCT root) FROM cc WHERE cc.image_id = vec_id) AS object_count
      FROM embeddings""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(planes(spark, d), 0.3)
    return regions.count_objects(masked, regions.mask_runs(masked))


@query(
    "remove_small_objects",
    f"WITH RECURSIVE {PX}, {OTSU}, {FG}, {small_sql('fg', 'kept', 3)} SELECT image_id, y, x FROM kept",
)
def _(spark, d):
    return fg_pixels(regions.remove_small_objects(otsu_runs(spark, d), 3))


@query(
    "fill_holes",
    f"WITH RECURSIVE {PX}, {OTSU}, {FG}, {fill_sql('fg', 'filled')} SELECT image_id, y, x FROM filled",
)
def _(spark, d):
    return fg_pixels(regions.fill_holes(otsu_runs(spark, d)))


@query(
    "clear_border",
    f"WITH RECURSIVE {PX}, {OTSU}, {FG}, {border_sql('fg', 'inner_')} SELECT image_id, y, x FROM inner_",
)
def _(spark, d):
    return fg_pixels(regions.clear_border(otsu_runs(spark, d)))


_CLEAN_FG = "fg AS (SELECT image_id, y, x FROM px WHERE v >= 0.15)"


@query(
    "clean_mask",
    f"""WITH RECURSIVE {PX}, {_CLEAN_FG}, {fill_sql('fg', 'filled')}, {small_sql('filled', 'kept', 2)},
      {border_sql('kept', 'inner_')} SELECT image_id, y, x FROM inner_""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(planes(spark, d), 0.15)
    return fg_pixels(regions.clean_mask(regions.mask_runs(masked), 2))


_DIST = """bgp AS (SELECT image_id, y, x FROM px ANTI JOIN fg USING (image_id, y, x)),
  dist AS (SELECT f.image_id, f.y, f.x, min((f.y - b.y) * (f.y - b.y) + (f.x - b.x) * (f.x - b.x)) AS d2
  FROM fg f JOIN bgp b ON b.image_id = f.image_id GROUP BY 1, 2, 3)"""


@query(
    "distance_transform",
    f"""WITH {PX}, {OTSU}, {FG}, {_DIST}
      SELECT px.image_id, px.y, px.x, round(coalesce(sqrt(d2), 0), 6) AS distance
      FROM px LEFT JOIN dist USING (image_id, y, x)""",
)
def _(spark, d):
    return pixel_rows(
        watershed.distance_transform(otsu_planes(spark, d)), "distance", "distance"
    ).withColumn("distance", F.round("distance", 6))


def _peaks_sql(d: int, ratio: str) -> str:
    return f"""{_DIST},
  top AS (SELECT image_id, max(d2) AS m2 FROM dist GROUP BY 1),
  wmax AS (SELECT a.image_id, a.y, a.x, any_value(a.d2) AS d2, max(b.d2) AS w2 FROM dist a JOIN dist b
    ON a.image_id = b.image_id AND abs(a.y - b.y) <= {d} AND abs(a.x - b.x) <= {d} GROUP BY 1, 2, 3),
  cand AS (SELECT image_id, y, x, d2, row_number() OVER (PARTITION BY image_id ORDER BY d2 DESC, y, x) AS rk
    FROM wmax JOIN top USING (image_id) WHERE d2 = w2 AND sqrt(d2) > sqrt(m2) * {ratio}),
  greedy AS (
    SELECT image_id, 0::BIGINT AS k, NULL::INTEGER AS y, NULL::INTEGER AS x, []::INTEGER[] AS ys, []::INTEGER[] AS xs, 0 AS marker FROM top
    UNION ALL
    SELECT image_id, rk, CASE WHEN ok THEN cy END, CASE WHEN ok THEN cx END,
      CASE WHEN ok THEN list_append(ys, cy) ELSE ys END, CASE WHEN ok THEN list_append(xs, cx) ELSE xs END,
      CASE WHEN ok THEN marker + 1 ELSE marker END
    FROM (SELECT g.image_id, c.rk, c.y AS cy, c.x AS cx, g.ys, g.xs, g.marker,
        NOT list_bool_or(list_append(list_transform(range(len(g.ys)), lambda i:
          greatest(abs(g.ys[i + 1] - c.y), abs(g.xs[i + 1] - c.x)) < {d}), false)) AS ok
      FROM greedy g JOIN cand c ON c.image_id = g.image_id AND c.rk = g.k + 1)),
  peaks AS (SELECT g.image_id, g.y, g.x, c.d2, g.marker FROM greedy g JOIN cand c
    ON c.image_id = g.image_id AND c.rk = g.k WHERE g.y IS NOT NULL)"""


@query(
    "peak_markers",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {_peaks_sql(2, '0.5::DOUBLE')}
      SELECT image_id, y, x, round(sqrt(d2), 6) AS distance, CAST(marker AS INTEGER) AS marker FROM peaks""",
)
def _(spark, d):
    measured = watershed.distance_transform(otsu_planes(spark, d))
    return watershed.peak_markers(measured, 2, 0.5).withColumn("distance", F.round("distance", 6))


def _flood_sql(rounds: int) -> str:
    """Synchronous relaxation; cost = level · 10⁶ + hops · 10³ + marker with level = -d²."""
    steps = [
        """f0 AS MATERIALIZED (SELECT dist.image_id, dist.y, dist.x, -dist.d2 AS lv,
           CASE WHEN marker IS NOT NULL THEN -dist.d2 * 1000000 + marker END AS c, marker IS NOT NULL AS fixed
           FROM dist LEFT JOIN peaks USING (image_id, y, x))"""
    ]
    for i in range(rounds):
        steps.append(
            f"""f{i + 1} AS MATERIALIZED (SELECT a.image_id, a.y, a.x, any_value(a.lv) AS lv, bool_or(a.fixed) AS fixed,
              CASE WHEN bool_or(a.fixed) THEN min(a.c) ELSE least(min(a.c),
                min(greatest(floor(b.c / 1000000), a.lv) * 1000000 + (b.c - floor(b.c / 1000000) * 1000000) + 1000)) END AS c
              FROM f{i} a LEFT JOIN f{i} b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.c IS NOT NULL
              GROUP BY 1, 2, 3)"""
        )
    return ",\n".join(steps)


@query(
    "split_touching",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {_peaks_sql(2, '0.5::DOUBLE')}, {_flood_sql(40)}
      SELECT image_id, y, x, CAST(c - floor(c / 1000) * 1000 AS INTEGER) AS label FROM f40 WHERE c IS NOT NULL""",
)
def _(spark, d):
    labels = watershed.split_touching(otsu_planes(spark, d), 2, 0.5)
    return regions.run_pixels(labels.select("image_id", "y", "label", "x0", "x1")).select(
        "image_id", "y", "x", "label"
    )


#: Links of neighbouring pixels taken from the deepest up, as long as none joins two markers. A part is the negative
#: number of its marker, or the smallest raster position in it.
_FOREST = """node AS (SELECT dist.image_id, dist.y, dist.x, dist.d2, marker FROM dist LEFT JOIN peaks USING (image_id, y, x)),
  link AS (SELECT a.image_id, a.y * 8 + a.x AS u, b.y * 8 + b.x AS v,
      row_number() OVER (PARTITION BY a.image_id ORDER BY greatest(-a.d2, -b.d2), a.y * 8 + a.x, b.y * 8 + b.x) AS k
    FROM node a JOIN node b ON a.image_id = b.image_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))),
  start AS (SELECT image_id, list(coalesce(-marker, p + 1) ORDER BY p) AS part
    FROM (SELECT image_id, p FROM (SELECT DISTINCT image_id FROM node), range(64) r(p))
    LEFT JOIN (SELECT image_id, y * 8 + x AS p, marker FROM node) USING (image_id, p) GROUP BY 1),
  forest AS (
    SELECT image_id, 0::BIGINT AS k, part FROM start
    UNION ALL
    SELECT image_id, k, CASE WHEN a = b OR (a < 0 AND b < 0) THEN part
        ELSE list_transform(part, lambda x: CASE WHEN x = greatest(a, b) THEN least(a, b) ELSE x END) END
    FROM (SELECT f.image_id, l.k, f.part, f.part[l.u + 1] AS a, f.part[l.v + 1] AS b
          FROM forest f JOIN link l ON l.image_id = f.image_id AND l.k = f.k + 1)),
  grown AS (SELECT image_id, arg_max(part, k) AS part FROM forest GROUP BY 1)"""


@query(
    "split_touching_forest",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {_peaks_sql(2, '0.5::DOUBLE')}, {_FOREST}
      SELECT image_id, y, x, CAST(-part[y * 8 + x + 1] AS INTEGER) AS label FROM node JOIN grown USING (image_id)
      WHERE part[y * 8 + x + 1] < 0""",
)
def _(spark, d):
    labels = watershed.split_touching(otsu_planes(spark, d), 2, 0.5, flooding="forest")
    return regions.run_pixels(labels.select("image_id", "y", "label", "x0", "x1")).select(
        "image_id", "y", "x", "label"
    )


@query(
    "should_split",
    f"""WITH RECURSIVE {PX}, fg AS (SELECT image_id, y, x FROM px WHERE v >= 0.25), {cc_sql('fg', 'cc', 8)},
      a AS (SELECT image_id, root, count(*) AS n FROM cc GROUP BY 1, 2),
      s AS (SELECT image_id, count(*) AS c, median(n) AS m, max(n) AS big, sum(n) / 64.0 AS f FROM a GROUP BY 1)
      SELECT vec_id AS image_id, coalesce(c, 0) AS object_count, CASE WHEN c IS NULL THEN false WHEN c = 1 THEN f > 0.01
        ELSE big > 3 * m OR (c <= 2 AND f > 0.015) END AS split FROM embeddings LEFT JOIN s ON image_id = vec_id""",
)
def _(spark, d):
    masked = pixelwise.manual_threshold(planes(spark, d), 0.25)
    return regions.should_split(masked, regions.mask_runs(masked))


@query(
    "measure_objects",
    f"""WITH {IPX}, lab AS (SELECT image_id, y, x, v, CAST(floor(v / 200) AS INTEGER) AS label FROM ipx WHERE v >= 800)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab GROUP BY 1, 2""",
)
def _(spark, d):
    df = planes(spark, d).withColumn(
        "pixels", F.transform("pixels", lambda v: F.floor((v + 1) * 1000).cast("double"))
    )
    labelled = (
        measure.explode_pixels(df.select("image_id", "height", "width", "pixels"))
        .filter("v >= 800")
        .withColumn("label", F.floor(F.col("v") / 200).cast("int"))
    )
    return rounded_objects(measure.measure_objects(watershed.runs_from_labels(labelled), df))


@query(
    "measurements_from_mask",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {cc_sql('fg', 'cc', 8)},
      lab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded_objects(
        measure.measurements_from_mask(otsu_runs(spark, d), planes(spark, d))
    )


_SEGMENT = f"""{PX}, {blur_sql('px', 'b')}, {otsu_sql('b', 'o')},
  fg AS (SELECT image_id, y, x FROM b JOIN o USING (image_id) WHERE v > t), {small_sql('fg', 'kept', 3)}"""


@query(
    "segment_objects",
    f"""WITH RECURSIVE {_SEGMENT}, {cc_sql('kept', 'cc', 8)},
      lab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded_objects(pipeline.segment_objects(planes(spark, d), min_object_size=3))


@query(
    "segment_objects_clean",
    f"""WITH RECURSIVE {_SEGMENT}, {fill_sql('kept', 'k2')}, {small_sql('k2', 'k3', 3)}, {border_sql('k3', 'k4')},
      {cc_sql('k4', 'cc', 8)},
      lab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded_objects(
        pipeline.segment_objects(planes(spark, d), min_object_size=3, clean_before_labeling=True)
    )


_KEPT_PEAKS = _peaks_sql(2, "0.5::DOUBLE").replace(" fg ", " kept ")


@query(
    "segment_objects_watershed",
    f"""WITH RECURSIVE {_SEGMENT}, {_KEPT_PEAKS}, {_flood_sql(40)},
      lab AS (SELECT image_id, y, x, CAST(c - floor(c / 1000) * 1000 AS INTEGER) AS label FROM f40 WHERE c IS NOT NULL)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded_objects(
        pipeline.segment_objects(
            planes(spark, d), min_object_size=3, labeling="watershed", watershed_min_distance=2
        )
    )


@query(
    "segment_objects_forest",
    f"""WITH RECURSIVE {_SEGMENT}, {_KEPT_PEAKS}, {_FOREST},
      lab AS (SELECT image_id, y, x, CAST(-part[y * 8 + x + 1] AS INTEGER) AS label FROM node JOIN grown USING (image_id)
        WHERE part[y * 8 + x + 1] < 0)
      SELECT image_id, label, {MEASURE}, {INTENSITY} FROM lab JOIN px USING (image_id, y, x) GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded_objects(
        pipeline.segment_objects(
            planes(spark, d), min_object_size=3, labeling="watershed", watershed_min_distance=2, watershed_flooding="forest"
        )
    )


@query(
    "batch_summary",
    f"""WITH RECURSIVE {_SEGMENT}, {cc_sql('kept', 'cc', 8)}
      SELECT vec_id AS image_id, CASE WHEN vec_id % 10 = 0 THEN 'failed' ELSE 'processed' END AS status,
        CASE WHEN vec_id % 10 = 0 THEN 'pixel count does not match the plane shape' END AS error,
        CASE WHEN vec_id % 10 <> 0 THEN (SELECT count(DISTINCT root) FROM cc WHERE cc.image_id = vec_id) END AS object_count
      FROM embeddings""",
)
def _(spark, d):
    damaged = planes(spark, d).withColumn(
        "pixels",
        F.when(F.col("image_id") % 10 == 0, F.slice("pixels", 1, 10)).otherwise(F.col("pixels")),
    )
    return pipeline.run_batch(damaged, min_object_size=3).summary


def _fraction(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 1.0 ELSE {top}::DOUBLE / {bottom} END"


@query(
    "compare_masks",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, fz AS (SELECT image_id, y, x FROM px WHERE v >= 0.1),
      {cc_sql('fg', 'ca', 8)}, {cc_sql('fz', 'cb', 8)},
      ab AS (SELECT image_id, v > t AS a, v >= 0.1 AS b FROM px JOIN o USING (image_id)),
      s AS (SELECT image_id, count(*) FILTER (a) AS fa, count(*) FILTER (b) AS fb, count(*) FILTER (a AND b) AS i,
        count(*) FILTER (a OR b) AS u, count(*) FILTER (a = b) AS e, count(*) AS n FROM ab GROUP BY 1)
      SELECT image_id, round({_fraction('i', 'u')}, 6) AS iou, round({_fraction('2 * i', '(fa + fb)')}, 6) AS dice,
        round({_fraction('e', 'n')}, 6) AS pixel_agreement, fa AS foreground_pixels_a, fb AS foreground_pixels_b,
        (SELECT count(DISTINCT root) FROM ca WHERE ca.image_id = s.image_id) AS object_count_a,
        (SELECT count(DISTINCT root) FROM cb WHERE cb.image_id = s.image_id) AS object_count_b FROM s""",
)
def _(spark, d):
    a = otsu_planes(spark, d)
    b = pixelwise.manual_threshold(planes(spark, d), 0.1)
    out = compare.compare_masks(a, b)
    return out.withColumns({c: F.round(c, 6) for c in ("iou", "dice", "pixel_agreement")})


@query(
    "compare_measurements",
    """WITH a AS (SELECT l_orderkey AS image_id, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
      b AS (SELECT l_orderkey AS image_id, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
      SELECT image_id, coalesce(a.n, 0) AS object_count_a, coalesce(b.n, 0) AS object_count_b,
        coalesce(a.n, 0) - coalesce(b.n, 0) AS count_difference, round(a.n / b.n, 6) AS count_ratio,
        round(a.m, 5) AS mean_area_a, round(b.m, 5) AS mean_area_b, round(a.m - b.m, 5) AS mean_area_difference,
        'area' AS area_column_a, 'AreaShape_Area' AS area_column_b FROM a FULL JOIN b USING (image_id)""",
)
def _(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    a = items.select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("area"))
    b = items.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_extendedprice").alias("AreaShape_Area")
    )
    out = compare.compare_measurements(a, b)
    return out.withColumns(
        {
            "count_ratio": F.round("count_ratio", 6),
            **{c: F.round(c, 5) for c in ("mean_area_a", "mean_area_b", "mean_area_difference")},
        }
    )


@query(
    "estimate_block_size",
    "SELECT vec_id AS image_id, 15 AS block_size, 20 AS min_size FROM embeddings",
)
def _(spark, d):
    blocks = stats.estimate_block_size(otsu_planes(spark, d))
    return blocks.join(stats.estimate_min_size(blocks), "image_id").select(
        "image_id", "block_size", "min_size"
    )


@query(
    "identity_columns",
    f"""WITH RECURSIVE {FRAMES}, {_SEGMENT}, {cc_sql('kept', 'cc', 8)},
      lab AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER) AS label FROM cc)
      SELECT stack_id, frame_index, frame_index AS z_index, 'img_' || image_id || '.tif' AS filename, image_id, label,
        CAST(count(*) AS DOUBLE) AS area FROM lab JOIN frames USING (image_id) GROUP BY 1, 2, 3, 4, 5, 6""",
)
def _(spark, d):
    from registry.inputs import framed_planes

    df = framed_planes(spark, d).withColumns(
        {
            "z_index": F.col("frame_index"),
            "source_path": F.concat(F.lit("/d/img_"), F.col("image_id").cast("string"), F.lit(".tif")),
        }
    )
    return pipeline.run_batch(df, min_object_size=3).measurements.select(
        "stack_id", "frame_index", "z_index", "filename", "image_id", "label", "area"
    )


def _shade(channel: int) -> str:
    palette = ", ".join(str(color[channel]) for color in pixelwise.LABEL_PALETTE)
    blend = f"floor(display * 0.5::DOUBLE + ([{palette}])[n % {len(pixelwise.LABEL_PALETTE)} + 1] * 0.5::DOUBLE)"
    return f"CAST(CASE WHEN n IS NULL THEN display ELSE {blend} END AS INTEGER)"


@query(
    "label_overlay",
    f"""WITH RECURSIVE {PX}, {OTSU}, {FG}, {cc_sql('fg', 'cc', 8)}, {DISPLAY},
      lab AS (SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS n FROM cc)
      SELECT image_id, y, x, {_shade(0)} AS r, {_shade(1)} AS g, {_shade(2)} AS b
      FROM disp LEFT JOIN lab USING (image_id, y, x)""",
)
def _(spark, d):
    df = planes(spark, d)
    labels = regions.label_objects(regions.mask_runs(histogram.otsu_threshold(df)))
    out = pixelwise.label_overlay(pipeline.runs_to_labels(df, labels))
    return measure.explode_pixels(
        out.select("image_id", "width", "overlay_r", "overlay_g", "overlay_b"),
        r="overlay_r",
        g="overlay_g",
        b="overlay_b",
    ).select("image_id", "y", "x", "r", "g", "b")


@query(
    "validation_report",
    f"""WITH m AS ({registry.ORACLES["compare_masks"]}),
      p AS (WITH {PX}, {INSPECT.format(src='px')} SELECT image_id, 8 AS height, 8 AS width, 1 AS channel_count, 'float64' AS dtype, round(min_value, 6) AS min_value,
        round(max_value, 6) AS max_value, round(max_value - min_value, 6) AS dynamic_range,
        round(mean_intensity, 6) AS mean_intensity, round(bg25, 6) AS background_std, round(snr, 6) AS estimated_snr,
        concat_ws('|', CASE WHEN snr < 3 THEN 'Low estimated SNR: thresholding may be unstable.' END,
          CASE WHEN max_value - min_value < 100 THEN 'Low dynamic range: weak foreground/background separation.' END) AS limitations
        FROM ins),
      r AS (SELECT *, object_count_a > 0 OR object_count_b > 0 AS found,
        foreground_pixels_a / nullif(object_count_a, 0) AS area_a, foreground_pixels_b / nullif(object_count_b, 0) AS area_b FROM m)
      SELECT p.*, iou AS mask_iou, dice AS mask_dice, pixel_agreement AS mask_pixel_agreement,
        foreground_pixels_a AS mask_foreground_pixels_a, foreground_pixels_b AS mask_foreground_pixels_b,
        object_count_a AS mask_object_count_a, object_count_b AS mask_object_count_b,
        CASE WHEN found THEN object_count_a END AS measure_object_count_a,
        CASE WHEN found THEN object_count_b END AS measure_object_count_b,
        CASE WHEN found THEN object_count_a - object_count_b END AS measure_count_difference,
        CASE WHEN object_count_a > 0 THEN round(object_count_a / nullif(object_count_b, 0), 6) END AS measure_count_ratio,
        round(area_a, 6) AS measure_mean_area_a, round(area_b, 6) AS measure_mean_area_b,
        round(area_a - area_b, 6) AS measure_mean_area_difference,
        CASE WHEN found THEN 'area' END AS measure_area_column_a, CASE WHEN found THEN 'area' END AS measure_area_column_b
      FROM p JOIN r USING (image_id)""",
)
def _(spark, d):
    df = planes(spark, d)
    report = compare.validation_report(df, otsu_planes(spark, d), pixelwise.manual_threshold(df, 0.1))

    def flat(part: str, prefix: str):
        for f in report.schema[part].dataType.fields:
            value = F.col(f"{part}.{f.name}")
            kind = f.dataType.simpleString()
            shown = F.round(value, 6) if kind == "double" else F.array_join(value, "|") if "array" in kind else value
            yield shown.alias(prefix + f.name)

    return report.select(
        "image_id",
        *flat("image_properties", ""),
        *flat("mask_comparison", "mask_"),
        *flat("measurement_comparison", "measure_"),
    )


@query("adaptive_segment")
def _(spark, d):
    decisions = adaptive.adaptive_segment(planes(spark, d), min_object_size=3).decisions
    return decisions.withColumn("warnings", F.array_join("warnings", "|"))


# Masks of every density on planes of up to 192×192: each pixel of a sheet is drawn as 3×3 pixels, and a quarter of the
# planes has no foreground. Distances go by columns first, then along the lines.
_LEVELS = "CASE image_id % 4 WHEN 0 THEN 9.0 WHEN 1 THEN 0.0 WHEN 2 THEN -0.15 ELSE -0.25 END"


def _large_masks(spark, d):
    small = sheets(spark, d).withColumn("_level", F.expr(_LEVELS))
    drawn = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("height") * 3 - 1),
            lambda y: F.transform(
                F.sequence(F.lit(0), F.col("width") * 3 - 1),
                lambda x: F.get("_mask", (F.floor(y / 3) * F.col("width") + F.floor(x / 3)).cast("int")),
            ),
        )
    )
    masks = small.withColumn("_mask", F.transform("pixels", lambda v: v > F.col("_level"))).withColumn("mask", drawn)
    return masks.select("image_id", (F.col("height") * 3).alias("height"), (F.col("width") * 3).alias("width"), "mask")


@query(
    "estimate_block_size_sheets",
    f"""WITH {SHEETS}, m AS (SELECT image_id, 3 * y + a AS y, 3 * x + b AS x, v > {_LEVELS} AS f FROM px, range(3) AS r(a), range(3) AS s(b)),
      edge AS (SELECT *, max(CASE WHEN NOT f THEN y END) OVER (PARTITION BY image_id, x ORDER BY y) AS up,
        min(CASE WHEN NOT f THEN y END) OVER (PARTITION BY image_id, x ORDER BY y DESC) AS down FROM m),
      g AS (SELECT image_id, y, x, f, least(coalesce(y - up, 100000), coalesce(down - y, 100000)) AS g FROM edge),
      dist AS (SELECT p.image_id, p.y, p.x, sqrt(min((p.x - q.x) * (p.x - q.x) + q.g * q.g)::DOUBLE) AS d
        FROM g p JOIN g q ON q.image_id = p.image_id AND q.y = p.y WHERE p.f GROUP BY 1, 2, 3),
      size AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM m GROUP BY 1),
      lim AS (SELECT *, CASE WHEN c % 2 = 1 THEN c WHEN c < 101 THEN c + 1 ELSE c - 1 END AS high
        FROM (SELECT *, least(greatest(least(h, w) // 4, 15), 101) AS c FROM size)),
      rad AS (SELECT image_id, quantile_cont(d, 0.75) AS r FROM dist WHERE d < 100000 GROUP BY 1),
      raw AS (SELECT image_id, h, w, high, least(greatest(CASE WHEN r IS NULL THEN high // 2
          ELSE round_even(greatest(6, r * 2) * 3, 0) END, 15), high)::INTEGER AS c FROM lim LEFT JOIN rad USING (image_id)),
      blk AS (SELECT *, CASE WHEN c % 2 = 1 THEN c WHEN c < high THEN c + 1 ELSE c - 1 END AS b FROM raw)
      SELECT image_id, CAST(b AS INTEGER) AS block_size, CAST(least(greatest(20, floor(pi() * pow(greatest(3, b // 6), 2) * 0.35)),
        greatest(20, h * w // 20)) AS INTEGER) AS min_size FROM blk""",
)
def _(spark, d):
    blocks = stats.estimate_block_size(_large_masks(spark, d))
    return blocks.join(stats.estimate_min_size(blocks), "image_id").select("image_id", "block_size", "min_size")
