"""Checked queries over measurement tables, listings and layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelframe.operators import layers, tables
from pixelframe.sources import inventory
from registry import query
from registry.inputs import table

# (l_orderkey, l_linenumber) repeats, so objects are numbered over all columns
OBJ = """obj AS (SELECT l_orderkey AS Image_Number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ObjectNumber,
    l_quantity AS AreaShape_Area, l_returnflag AS flag FROM lineitem)"""


def objects(spark, d):
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("Image_Number"),
        number.cast("bigint").alias("ObjectNumber"),
        F.col("l_quantity").alias("AreaShape_Area"),
        F.col("l_returnflag").alias("flag"),
    )


def image_table(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("Image_Number"),
        F.concat(F.lit("/in/img_"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("FileName"),
        F.col("o_totalprice").alias("AreaShape_Area"),
    )


def experiment_table(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return (
        table(spark, d, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .filter("o_orderstatus <> 'P'")
        .select(F.col("o_orderkey").alias("Image_Number"), F.col("c_mktsegment").alias("Plate_Name"))
    )


@query(
    "merge_object_tables",
    f"""WITH {OBJ}, a AS (SELECT Image_Number, ObjectNumber, AreaShape_Area FROM obj WHERE flag <> 'A'),
      b AS (SELECT Image_Number, ObjectNumber, AreaShape_Area * 2 AS AreaShape_Area, flag FROM obj WHERE flag <> 'N')
      SELECT Image_Number, ObjectNumber, a.AreaShape_Area, b.AreaShape_Area AS "AreaShape_Area_Nuclei", b.flag
      FROM a FULL JOIN b USING (Image_Number, ObjectNumber)""",
)
def _(spark, d):
    obj = objects(spark, d)
    a = obj.filter("flag <> 'A'").drop("flag")
    b = obj.filter("flag <> 'N'").withColumn("AreaShape_Area", F.col("AreaShape_Area") * 2)
    return tables.merge_object_tables({"Cells": a, "Nuclei": b})


@query(
    "merge_image_tables",
    """WITH i AS (SELECT o_orderkey AS Image_Number, '/in/img_' || o_orderkey || '.tif' AS FileName, o_totalprice AS AreaShape_Area FROM orders),
      e AS (SELECT o_orderkey AS Image_Number, c_mktsegment AS Plate_Name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
      SELECT Image_Number, FileName, AreaShape_Area, Plate_Name FROM i FULL JOIN e USING (Image_Number)""",
)
def _(spark, d):
    return tables.merge_image_tables({"E_Image": image_table(spark, d), "E_Experiment": experiment_table(spark, d)})


@query(
    "merge_measurements",
    f"""WITH {OBJ}, a AS (SELECT Image_Number, ObjectNumber, AreaShape_Area FROM obj WHERE flag <> 'A'),
      b AS (SELECT Image_Number, ObjectNumber, flag FROM obj WHERE flag <> 'N'),
      ab AS (SELECT Image_Number, ObjectNumber, a.AreaShape_Area, b.flag FROM a FULL JOIN b USING (Image_Number, ObjectNumber))
      SELECT ab.*, c_mktsegment AS Plate_Name, '/in/img_' || i.o_orderkey || '.tif' AS FileName,
        i.o_totalprice AS "AreaShape_Area_E_Image"
      FROM ab LEFT JOIN (SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus <> 'P') e ON e.o_orderkey = ab.Image_Number
      LEFT JOIN orders i ON i.o_orderkey = ab.Image_Number""",
)
def _(spark, d):
    obj = objects(spark, d)
    merged, _ = tables.merge_measurements(
        {
            "E_IdentifyPrimaryObjects": obj.filter("flag <> 'A'").drop("flag"),
            "E_IdentifySecondaryObjects": obj.filter("flag <> 'N'").drop("AreaShape_Area"),
            "E_Experiment": experiment_table(spark, d),
            "E_Image": image_table(spark, d),
            "Legacy_Image": image_table(spark, d).drop("Image_Number"),
        }
    )
    return merged


@query(
    "processed_image_names",
    """WITH u AS (SELECT 'img_' || (o_orderkey % 7000) || '.tif' AS name, 0 AS r, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT 'img_' || o_orderkey || '.tif', 1, o_orderkey FROM orders),
      f AS (SELECT name, min(r * 10000000000 + k) AS m FROM u GROUP BY 1)
      SELECT name, CAST(m // 10000000000 AS INTEGER) AS table_rank, CAST(m % 10000000000 AS BIGINT) AS first_key FROM f""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    first = orders.select(
        F.col("o_orderkey").alias("Image_Number"),
        F.when(
            F.col("o_orderstatus") != "F",
            F.concat(F.lit("C:\\in\\img_"), (F.col("o_orderkey") % 7000).cast("string"), F.lit(".tif")),
        ).alias("FileName_DNA"),
    )
    return tables.processed_image_names({"A_Image": first, "B_Image": image_table(spark, d)})


@query(
    "summarize_tables",
    """SELECT 'Cells' AS "table", count(*) AS rows, 4 AS columns FROM lineitem
      UNION ALL SELECT 'E_Image', count(*), 3 FROM orders""",
)
def _(spark, d):
    return tables.summarize_tables({"Cells": objects(spark, d), "E_Image": image_table(spark, d)})


@query(
    "normalize_columns",
    "SELECT o_orderkey AS Image_Number, o_orderpriority FROM orders",
)
def _(spark, d):
    raw = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ImageNumber"), "o_orderpriority"
    )
    return tables.normalize_columns(raw, "E_Image")[0]


_CATALOG = """cat AS (SELECT c_custkey, 'T' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '_Experiment' WHEN 1 THEN '_Image'
    WHEN 2 THEN '_IdentifyPrimaryObjects' ELSE '' END AS "table",
    c_nationkey % 2 = 0 AS img, c_nationkey % 3 = 0 AS obj, c_acctbal < 0 AS kv FROM customer)"""


def _table_names(spark, d):
    k = F.col("c_custkey") % 5
    suffix = F.when(k == 0, "_Experiment").when(k == 1, "_Image").when(k == 2, "_IdentifyPrimaryObjects").otherwise("")
    return table(spark, d, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string"), suffix).alias("table"),
        F.array_compact(
            F.array(
                F.when(F.col("c_nationkey") % 2 == 0, F.lit("Image_Number")),
                F.when(F.col("c_nationkey") % 3 == 0, F.lit("ObjectNumber")),
                F.when(F.col("c_acctbal") < 0, F.lit("Key")),
                F.when(F.col("c_acctbal") < 0, F.lit("Value")),
            )
        ).alias("columns"),
    )


@query(
    "classify_tables",
    f"""WITH {_CATALOG}, t AS (SELECT *, CASE WHEN "table" LIKE '%\\_Experiment' ESCAPE '\\' OR kv THEN 'experiment'
        WHEN "table" LIKE '%\\_Image' ESCAPE '\\' THEN 'image' WHEN "table" LIKE '%IdentifyPrimaryObjects%' OR obj THEN 'object'
        WHEN img THEN 'image' ELSE 'other' END AS k FROM cat),
      m AS (SELECT *, img AND (k <> 'object' OR obj) AS ok FROM t)
      SELECT "table", CASE WHEN ok THEN k ELSE 'non_standard' END AS table_type, NOT ok AS legacy, ok AS mergeable,
        CASE WHEN ok THEN 0 ELSE 1 END AS n_warnings FROM m""",
)
def _(spark, d):
    return tables.classify_tables(_table_names(spark, d)).select(
        "table", "table_type", "legacy", "mergeable", F.size("warnings").alias("n_warnings")
    )


# The same catalog with whole warning texts.
@query(
    "classify_tables_warnings",
    f"""WITH {_CATALOG}, t AS (SELECT *, CASE WHEN "table" LIKE '%\\_Experiment' ESCAPE '\\' OR kv THEN 'experiment'
        WHEN "table" LIKE '%\\_Image' ESCAPE '\\' THEN 'image' WHEN "table" LIKE '%IdentifyPrimaryObjects%' OR obj THEN 'object'
        WHEN img THEN 'image' ELSE 'other' END AS k FROM cat),
      m AS (SELECT *, concat_ws(', ', CASE WHEN NOT img THEN 'Image_Number' END,
        CASE WHEN k = 'object' AND NOT obj THEN 'ObjectNumber' END) AS lacking FROM t)
      SELECT "table", CASE WHEN lacking <> '' THEN "table" || ': ' || CASE WHEN k = 'other' THEN '' ELSE k || ' ' END || 'table missing '
        || lacking || '; loaded as ' || CASE WHEN k = 'other' THEN '' ELSE 'legacy/' END
        || 'non-standard table and excluded from merge.' END AS warning FROM m""",
)
def _(spark, d):
    return tables.classify_tables(_table_names(spark, d)).select("table", F.get("warnings", F.lit(0)).alias("warning"))


@query(
    "combine_measurements",
    """SELECT l_orderkey AS image_id, l_quantity AS area, l_tax AS mean_intensity, NULL::INTEGER AS t_index FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT l_orderkey, l_quantity, NULL, l_linenumber FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R'""",
)
def _(spark, d):
    items = table(spark, d, "lineitem")
    a = items.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("area"), F.col("l_tax").alias("mean_intensity")
    )
    b = items.filter("NOT l_returnflag <=> 'R'").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_quantity").alias("area"), F.col("l_linenumber").alias("t_index")
    )
    return tables.combine_measurements([a, b])


# --- listings ----------------------------------------------------------------------------------

EXTENSIONS = ["tif", "TIFF", "png", "jpg", "jpeg", "oir", "czi", "txt"]
_LISTING = """lst AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'sub/' ELSE '' END
    || CASE WHEN o_orderkey % 2 = 0 THEN 'Img_' ELSE 'img_' END || (o_orderkey % 900) || '.'
    || ['tif', 'TIFF', 'png', 'jpg', 'jpeg', 'oir', 'czi', 'txt'][o_orderkey % 8 + 1] AS path,
    CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS depth FROM orders)"""


def listing(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(
            F.when(key % 11 == 0, "sub/").otherwise(""),
            F.when(key % 2 == 0, "Img_").otherwise("img_"),
            (key % 900).cast("string"),
            F.lit("."),
            F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (key % 8).cast("int")),
        ).alias("path"),
        F.when(key % 11 == 0, 1).otherwise(0).alias("depth"),
    )


@query(
    "detect_images",
    f"""WITH {_LISTING}, p AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, depth,
        lower(regexp_extract(path, '[^.]*$')) AS ext FROM lst),
      r AS (SELECT path, name, CASE WHEN ext = 'oir' THEN 7 WHEN depth = 0 THEN
        list_position(['tif', 'tiff', 'png', 'jpg', 'jpeg', 'czi'], ext) END AS priority FROM p),
      f AS (SELECT DISTINCT ON (lower(name)) path, name, priority FROM r WHERE priority > 0 ORDER BY lower(name), priority, name, path)
      SELECT path, name, CAST(priority AS INTEGER) AS priority FROM f""",
)
def _(spark, d):
    return inventory.detect_images(listing(spark, d))


@query(
    "discover_outputs",
    """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Masks/' WHEN 1 THEN 'a/labels/b/' WHEN 2 THEN 'raw/' WHEN 3 THEN '' ELSE 'qc_old/' END
        || 'f_' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.csv' ELSE '.TIF' END AS relative_path FROM orders)
      SELECT o_orderkey, relative_path FROM p WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 NOT IN (0, 1)""",
)
def _(spark, d):
    key = F.col("o_orderkey")
    folder = F.get(F.array(*[F.lit(x) for x in ["Masks/", "a/labels/b/", "raw/", "", "qc_old/"]]), (key % 5).cast("int"))
    files = table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(folder, F.lit("f_"), key.cast("string"), F.when(key % 3 == 0, ".csv").otherwise(".TIF")).alias("relative_path"),
    )
    return inventory.discover_outputs(files)


@query(
    "combine_inventories",
    f"""WITH {_LISTING} SELECT DISTINCT path FROM lst WHERE lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff'""",
)
def _(spark, d):
    files = listing(spark, d).select("path")
    return inventory.combine_inventories(
        [files.filter(F.lower("path").endswith(".tif")), files.filter(F.lower("path").rlike(r"\.tiff?$"))]
    )


@query(
    "missing_paths",
    f"""WITH {_LISTING} SELECT DISTINCT path FROM lst WHERE depth = 0 EXCEPT SELECT path FROM lst WHERE o_orderkey % 3 = 0""",
)
def _(spark, d):
    files = listing(spark, d)
    return inventory.missing_paths(
        files.filter("depth = 0").select("path"), files.filter("o_orderkey % 3 = 0").select("path")
    )


@query(
    "file_pairs",
    """SELECT '/in/img_' || o_orderkey || '.oir' AS input_path, '/out/img_' || o_orderkey || '.tif' AS output_path FROM orders""",
)
def _(spark, d):
    files = table(spark, d, "orders").select(
        F.concat(F.lit("/in/img_"), F.col("o_orderkey").cast("string"), F.lit(".oir")).alias("path")
    )
    return inventory.file_pairs(files, "/out")


# customers are images, suppliers are layers: few names match exactly, others are contained
_MATCH = """img AS (SELECT c_custkey, 'c' || c_custkey || '.tif' AS image_name, 'c' || c_custkey AS st FROM customer),
  lay AS (SELECT '/m/' || CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey ELSE 'x_c' || (s_suppkey * 13) || '_mask' END
    || CASE WHEN s_suppkey % 2 = 0 THEN '.tif' ELSE '.tiff' END AS layer_path,
    CASE WHEN s_suppkey % 3 = 0 THEN 'c' || s_suppkey ELSE 'x_c' || (s_suppkey * 13) || '_mask' END AS ls, s_suppkey % 2 AS late FROM supplier)"""
_MATCHED = f"""{_MATCH}, m AS (SELECT image_name, layer_path, row_number() OVER (PARTITION BY image_name
    ORDER BY CASE WHEN ls = st THEN 0 ELSE 1 END, late, layer_path) AS rn FROM img JOIN lay ON contains(ls, st))"""


def _images(spark, d):
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("image_name")
    )


def _layers(spark, d):
    key = F.col("s_suppkey")
    base = F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).otherwise(
        F.concat(F.lit("x_c"), (key * 13).cast("string"), F.lit("_mask"))
    )
    return table(spark, d, "supplier").select(
        F.concat(F.lit("/m/"), base, F.when(key % 2 == 0, ".tif").otherwise(".tiff")).alias("layer_path")
    )


@query(
    "match_outputs",
    f"WITH {_MATCHED} SELECT img.image_name, layer_path FROM img LEFT JOIN m ON m.image_name = img.image_name AND rn = 1",
)
def _(spark, d):
    return layers.match_outputs(_images(spark, d), _layers(spark, d))


@query(
    "attach_layers",
    f"""WITH {_MATCHED}, lb AS (SELECT image_name, label_path, row_number() OVER (PARTITION BY image_name
        ORDER BY CASE WHEN ls = st THEN 0 ELSE 1 END, label_path) AS rn FROM img JOIN
        (SELECT '/l/c' || s_suppkey || '.tif' AS label_path, 'c' || s_suppkey AS ls FROM supplier) ON contains(ls, st))
      SELECT image_name, layer_path AS mask_path, label_path FROM (SELECT * FROM m WHERE rn = 1)
      FULL JOIN (SELECT * FROM lb WHERE rn = 1) USING (image_name)""",
)
def _(spark, d):
    labels = table(spark, d, "supplier").select(
        F.concat(F.lit("/l/c"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("layer_path")
    )
    return layers.attach_layers(_images(spark, d), _layers(spark, d), labels)
