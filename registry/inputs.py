"""Images, tables, logs and listings derived from the given tables, in Spark and in SQL.

``embeddings`` rows are 8×8 planes (``label`` is the stack), ``lineitem``/``orders``/
``customer`` are measurement tables and file listings, ``events`` are logs and timings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.operators.bands import bands_from_lines
from pixelframe.operators.ranking import ordinal
from pixelframe.sources.planes import planes_from_arrays

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planes, as they are read: narrow operators shuffle nothing."""
    return planes_from_arrays(
        table(spark, sf_dir, "embeddings"),
        image_id="vec_id",
        values="embedding",
        height=SIDE,
        width=SIDE,
        stack_id="label",
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger planes: 64 vectors in order of id are the lines of one, the last plane has those left over."""
    lines = ordinal(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), [], ["vec_id"], "n")
    line = F.struct((F.pmod(F.col("n") - 1, F.lit(64))).alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return (
        lines.groupBy(F.expr("(n - 1) div 64").alias("image_id"))
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        .select(
            "image_id",
            F.lit(0).alias("stack_id"),
            F.size("lines").alias("height"),
            F.lit(64).alias("width"),
            F.lit("float64").alias("dtype"),
            F.flatten("lines.v").alias("pixels"),
        )
    )


def long_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plane that grows with the table, in bands of 48 lines: vector after vector in order of id is its next line."""
    lines = ordinal(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), [], ["vec_id"], "n").select(
        F.lit(0).cast("bigint").alias("image_id"), (F.col("n") - 1).alias("y"), F.col("embedding").alias("line")
    )
    return bands_from_lines(lines, lines.groupBy("image_id").agg(F.count("y").alias("plane_height")), 48)


def int_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).withColumns(
        {
            "pixels": F.transform("pixels", lambda v: F.floor((v + 1) * 1000).cast("double")),
            "dtype": F.lit("uint16"),
        }
    )


def framed_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes with their position inside the stack."""
    numbered = ordinal(
        table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("image_id"), F.col("label").alias("stack_id")
        ),
        ["stack_id"],
        ["image_id"],
        "_n",
    ).select("image_id", (F.col("_n") - 1).cast("int").alias("frame_index"))
    return planes(spark, sf_dir).join(numbered, "image_id")


# SQL twins ---------------------------------------------------------------------------------

PX = """px AS (
  SELECT vec_id AS image_id, label AS stack_id,
         CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) AS t(i))"""

SHEETS = """px AS (
  SELECT CAST((r - 1) // 64 AS BIGINT) AS image_id, CAST((r - 1) % 64 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), range(1, 65) AS t(i))"""

def long_sql(value: str = "e") -> str:
    """``px`` of :func:`long_plane`, with pixels made from the vector components ``e``."""
    return f"""px AS (
  SELECT CAST(0 AS BIGINT) AS image_id, CAST(r - 1 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, {value} AS v
  FROM (SELECT r, i, CAST(embedding[i] AS DOUBLE) AS e
    FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), range(1, 65) AS t(i))),
  dim AS (SELECT CAST(max(y) AS INTEGER) AS last FROM px)"""


IPX = """ipx AS (
  SELECT vec_id AS image_id, label AS stack_id,
         CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         floor((CAST(embedding[i] AS DOUBLE) + 1) * 1000) AS v
  FROM embeddings, range(1, 65) AS t(i))"""

FRAMES = """frames AS (
  SELECT vec_id AS image_id, label AS stack_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_index
  FROM embeddings)"""


def otsu_sql(source: str, name: str) -> str:
    """Occupied-bin Otsu thresholds ``name(image_id, t)`` of a float pixel CTE ``source``."""
    return f"""{name}_rng AS (
  SELECT image_id, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY image_id),
{name}_hist AS (
  SELECT p.image_id, CASE WHEN lo = hi THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 256), 255) END AS bin,
         any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n
  FROM {source} p JOIN {name}_rng USING (image_id) GROUP BY 1, 2),
{name}_cen AS (
  SELECT image_id, bin, n,
         CASE WHEN lo = hi THEN lo ELSE lo + (hi - lo) / 256 / 2 + bin * ((hi - lo) / 256) END AS c
  FROM {name}_hist),
{name}_cum AS (
  SELECT image_id, bin, c, CAST(sum(n) OVER w AS DOUBLE) AS w1, sum(n * c) OVER w AS s1,
         CAST(sum(n) OVER g AS DOUBLE) AS wt, sum(n * c) OVER g AS st
  FROM {name}_cen
  WINDOW w AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING),
         g AS (PARTITION BY image_id)),
{name}_var AS (
  SELECT image_id, bin, c, CASE WHEN w1 = wt THEN -1.0 ELSE
         w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) * (s1 / w1 - (st - s1) / (wt - w1)) END AS var
  FROM {name}_cum),
{name} AS (
  SELECT image_id, c AS t FROM (
    SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY var DESC, bin) AS rn
    FROM {name}_var) WHERE rn = 1)"""


def blur_sql(source: str, name: str, sigma: float = 1.0) -> str:
    """Separable Gaussian of an 8×8 pixel CTE, vertical then horizontal, reflected border."""
    radius = int(4 * sigma + 0.5)

    def fold(expr: str) -> str:
        m = f"((({expr}) % 16) + 16) % 16"
        return f"(CASE WHEN {m} < 8 THEN {m} ELSE 15 - {m} END)"

    return f"""{name}_k AS (
  SELECT k, exp(-0.5 * k * k / ({sigma} * {sigma})) / sum(exp(-0.5 * k * k / ({sigma} * {sigma}))) OVER () AS w
  FROM range(-{radius}, {radius} + 1) AS t(k)),
{name}_rows AS (SELECT DISTINCT image_id, y, x FROM {source}),
{name}_v AS (
  SELECT r.image_id, r.y, r.x, sum(w * v) AS v
  FROM {name}_rows r, {name}_k JOIN {source} p
    ON p.image_id = r.image_id AND p.x = r.x AND p.y = {fold('r.y + k')} GROUP BY 1, 2, 3),
{name} AS (
  SELECT r.image_id, r.y, r.x, sum(w * v) AS v
  FROM {name}_rows r, {name}_k JOIN {name}_v p
    ON p.image_id = r.image_id AND p.y = r.y AND p.x = {fold('r.x + k')} GROUP BY 1, 2, 3)"""
