"""Checked queries over run logs, timings, freshness and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelframe.functions import names
from pixelframe.operators import layers, logs, runs
from registry import query
from registry.inputs import table

# One log line per event: event_id is the line number inside the user's log.
_LINE = """CASE WHEN event_type = 'view' THEN CASE event_id % 6 WHEN 0 THEN '[OIR] input path: /in/img_' || event_id || '.oir'
      WHEN 1 THEN ' [OIR] timing read_seconds: ' || value || ' ' WHEN 2 THEN '[OIR] timing conversion_seconds: ' || value
      WHEN 3 THEN '[OIR] timing write_seconds: ' || value WHEN 4 THEN '[OIR] saveAs target: /out/a:' || event_id || '.tif'
      ELSE '[OIR] saved file verified on disk: /out/v' || event_id || '.tif' END
    WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'Error in module M' || (event_id % 4)
    WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'Encountered error E' || (event_id % 3)
    WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'KeyError: ''k' || (event_id % 5) || ''''
    WHEN event_type = 'click' AND user_id % 7 = 1 THEN 'Traceback (most recent call last):'
    WHEN event_type = 'signup' AND user_id % 5 = 0 THEN 'java.lang.NullPointerException at ' || event_id
    WHEN event_type = 'purchase' AND user_id % 10 = 2 AND value > 60 THEN 'Failed to load pipeline ' || event_id
    WHEN event_type = 'purchase' THEN '  ' ELSE 'step ' || event_id END"""
LINES = f"lines AS (SELECT user_id AS run_id, event_id AS pos, {_LINE} AS line FROM events)"


def lines(spark, d):
    n, run, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    key, value = n.cast("string"), F.col("value").cast("string")

    def mod(k):
        return (n % k).cast("string")

    tagged = F.get(
        F.array(
            F.concat(F.lit("[OIR] input path: /in/img_"), key, F.lit(".oir")),
            F.concat(F.lit(" [OIR] timing read_seconds: "), value, F.lit(" ")),
            F.concat(F.lit("[OIR] timing conversion_seconds: "), value),
            F.concat(F.lit("[OIR] timing write_seconds: "), value),
            F.concat(F.lit("[OIR] saveAs target: /out/a:"), key, F.lit(".tif")),
            F.concat(F.lit("[OIR] saved file verified on disk: /out/v"), key, F.lit(".tif")),
        ),
        (n % 6).cast("int"),
    )
    line = (
        F.when(kind == "view", tagged)
        .when((kind == "error") & (run % 3 == 0), F.concat(F.lit("Error in module M"), mod(4)))
        .when((kind == "error") & (run % 3 == 1), F.concat(F.lit("Encountered error E"), mod(3)))
        .when((kind == "click") & (run % 4 == 0), F.concat(F.lit("KeyError: 'k"), mod(5), F.lit("'")))
        .when((kind == "click") & (run % 7 == 1), "Traceback (most recent call last):")
        .when(
            (kind == "signup") & (run % 5 == 0),
            F.concat(F.lit("java.lang.NullPointerException at "), key),
        )
        .when(
            (kind == "purchase") & (run % 10 == 2) & (F.col("value") > 60),
            F.concat(F.lit("Failed to load pipeline "), key),
        )
        .when(kind == "purchase", "  ")
        .otherwise(F.concat(F.lit("step "), key))
    )
    return table(spark, d, "events").select(run.alias("run_id"), n.alias("pos"), line.alias("line"))


def run_table(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_custkey") % 6 == 0, 1).otherwise(0).alias("exit_code"),
    )


RUNS = "runs AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS exit_code FROM customer)"
_CONSOLE = "regexp_matches(line, 'VerifyError|File not found:|Import failed:|Open failed:|Unsupported format|Exception in|java\\.lang\\.')"

_BLOCKS = f"""tag AS (SELECT run_id, pos, trim(line) AS line FROM {{src}} WHERE trim(line) LIKE '[OIR] %'),
  num AS (SELECT *, sum((line LIKE '[OIR] input path:%')::INT) OVER (PARTITION BY run_id ORDER BY pos) AS block,
    trim(substr(line, strpos(line, ':') + 1)) AS val FROM tag),
  rec AS (SELECT run_id, block, arg_max(val, pos) FILTER (line LIKE '[OIR] input path:%') AS input_path,
    arg_max(val, pos) FILTER (line LIKE '[OIR] saveAs target:%' OR line LIKE '[OIR] saved file%') AS output_path,
    coalesce(arg_max(val, pos) FILTER (line LIKE '%read_seconds:%')::DOUBLE, 0) AS read_seconds,
    coalesce(arg_max(val, pos) FILTER (line LIKE '%conversion_seconds:%')::DOUBLE, 0) AS conversion_seconds,
    coalesce(arg_max(val, pos) FILTER (line LIKE '%write_seconds:%')::DOUBLE, 0) AS write_seconds
    FROM num WHERE block > 0 GROUP BY 1, 2)""".replace("{src}", "lines")


@query(
    "parse_file_timings",
    f"""WITH {LINES}, {_BLOCKS} SELECT run_id, CAST(block AS BIGINT) AS block, input_path, output_path, read_seconds,
      conversion_seconds, write_seconds, round(read_seconds + conversion_seconds + write_seconds, 6) AS total_seconds FROM rec""",
)
def _(spark, d):
    return logs.parse_file_timings(lines(spark, d)).withColumn(
        "total_seconds", F.round("total_seconds", 6)
    )


@query(
    "extract_run_errors",
    f"""WITH {LINES}, s AS (SELECT run_id, pos, trim(line) AS line FROM lines WHERE trim(line) <> ''),
      k AS (SELECT *, CASE WHEN lower(line) LIKE '%traceback (most recent call last)%' THEN 't'
        WHEN regexp_matches(line, '(?i)\\b(error detected during run of|error in|exception in|encountered error in)\\s+module\\b') THEN 'm'
        WHEN regexp_matches(line, '^[A-Z]\\w*(Error|Exception)(:\\s*.+)?$') THEN 'e'
        WHEN regexp_matches(lower(line), 'failed to load pipeline|could not find the |error in module|encountered error|unable to complete') THEN 'x' END AS k FROM s),
      f AS (SELECT run_id, bool_or(k IN ('t', 'e')) AND bool_or(k IN ('m', 'e')) AS term FROM k WHERE k IS NOT NULL GROUP BY 1),
      g AS (SELECT run_id, k, line, min(pos) AS pos FROM k WHERE k IN ('m', 'x') GROUP BY 1, 2, 3),
      e AS (SELECT run_id, arg_max(line, pos) AS line, max(pos) AS pos FROM k WHERE k = 'e' GROUP BY 1)
      SELECT run_id, CASE k WHEN 'm' THEN 0 ELSE 1 END AS section, pos, line FROM g JOIN f USING (run_id) WHERE k = 'm' OR NOT term
      UNION ALL SELECT run_id, 1, pos, line FROM e JOIN f USING (run_id) WHERE term""",
)
def _(spark, d):
    return logs.extract_run_errors(lines(spark, d))


@query(
    "extract_marker_errors",
    f"WITH {LINES} SELECT run_id, pos, trim(line) AS line FROM lines WHERE {_CONSOLE}",
)
def _(spark, d):
    return logs.extract_marker_errors(lines(spark, d))


@query(
    "error_summary",
    f"""WITH {LINES}, {RUNS}, s AS (SELECT run_id, pos, trim(line) AS line FROM lines WHERE trim(line) <> ''),
      e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS rn FROM s WHERE {_CONSOLE}),
      t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS rn FROM s)
      SELECT run_id, pos, line FROM e WHERE rn <= 8
      UNION ALL SELECT run_id, pos, line FROM t WHERE rn <= 8 AND run_id NOT IN (SELECT run_id FROM e)
      UNION ALL SELECT run_id, 0, 'Fiji produced no captured console output.' FROM runs WHERE run_id NOT IN (SELECT run_id FROM s)""",
)
def _(spark, d):
    return logs.error_summary(run_table(spark, d), lines(spark, d))


@query(
    "run_succeeded",
    f"""WITH {LINES}, {RUNS} SELECT run_id, exit_code, exit_code = 0 AND run_id NOT IN (SELECT run_id FROM lines
      WHERE regexp_matches(lower(line), 'failed to load pipeline|could not find the ')) AS succeeded FROM runs""",
)
def _(spark, d):
    return logs.run_succeeded(run_table(spark, d), lines(spark, d))


@query(
    "run_succeeded_console",
    f"""WITH {LINES}, {RUNS} SELECT run_id, exit_code, exit_code = 0 AND run_id NOT IN (SELECT run_id FROM lines
      WHERE {_CONSOLE}) AS succeeded FROM runs""",
)
def _(spark, d):
    return logs.run_succeeded(run_table(spark, d), lines(spark, d), console=True)


@query(
    "log_tail",
    f"""WITH {LINES} SELECT run_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS rn
      FROM lines) WHERE rn <= 20""",
)
def _(spark, d):
    return logs.log_tail(lines(spark, d), 20, "run_id")


@query("preview", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def _(spark, d):
    return logs.preview(table(spark, d, "pages").select("page_id", "url"), ["page_id"], 20)


@query(
    "imageset_rows",
    """SELECT CAST(row_number() OVER (ORDER BY name, path) AS INTEGER) AS cycle, name AS "DNA", '' AS "Actin" FROM (
      SELECT 'img_' || o_orderkey || '.tif' AS name, '/in/' || o_orderkey AS path FROM orders)""",
)
def _(spark, d):
    key = F.col("o_orderkey").cast("string")
    images = table(spark, d, "orders").select(
        F.concat(F.lit("img_"), key, F.lit(".tif")).alias("name"), F.concat(F.lit("/in/"), key).alias("path")
    )
    return runs.imageset_rows(images, ["DNA", "Actin"])


_STAGE_NAMES = [*runs.TIMING_KEYS[:18], "total_seconds", "custom_step_seconds"]
_STAGES = f"""stages AS (SELECT user_id AS run_id, {[str(s) for s in _STAGE_NAMES]}[event_id % 20 + 1] AS stage, value AS seconds FROM events)"""


def stages(spark, d):
    known = F.array(*[F.lit(s) for s in _STAGE_NAMES])
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.get(known, (F.col("event_id") % 20).cast("int")).alias("stage"),
        F.col("value").alias("seconds"),
    )


@query(
    "workflow_timing",
    f"""WITH {_STAGES}, s AS (SELECT run_id,
        coalesce(sum(seconds) FILTER (stage IN ('cellprofiler_startup_seconds', 'cellprofiler_subprocess_seconds')), 0) AS c,
        coalesce(sum(seconds) FILTER (stage IN ('fiji_startup_seconds', 'fiji_subprocess_seconds', 'fiji_postprocess_seconds')), 0) AS f,
        coalesce(sum(seconds) FILTER (stage = 'total_seconds'), 0) AS t,
        coalesce(sum(seconds) FILTER (stage NOT IN ('total_seconds', 'unaccounted_seconds', 'cellprofiler_seconds', 'fiji_export_seconds')), 0) AS a
        FROM stages GROUP BY 1)
      SELECT run_id, round(c, 4) AS cellprofiler_seconds, round(f, 4) AS fiji_export_seconds, round(t, 4) AS total_seconds,
        round(greatest(t - a, 0), 4) AS unaccounted_seconds FROM s""",
)
def _(spark, d):
    out = runs.workflow_timing(stages(spark, d))
    return out.select("run_id", *[F.round(c, 4).alias(c) for c in out.columns if c != "run_id"])


@query(
    "timing_breakdown",
    f"""WITH {_STAGES}, s AS (SELECT run_id, stage, round(sum(seconds), 2) AS v FROM stages GROUP BY 1, 2)
      SELECT run_id, CAST(list_position({[str(s) for s in runs.TIMING_KEYS]}, stage) AS INTEGER) AS line_no,
        '  ' || replace(replace(stage, '_seconds', ''), '_', ' ') || ': ' || printf('%.2f', v) || 's' AS line
      FROM s WHERE stage <> 'custom_step_seconds'
      UNION ALL SELECT DISTINCT run_id, 0, 'Workflow timing breakdown:' FROM stages""",
)
def _(spark, d):
    return runs.timing_breakdown(stages(spark, d))


_FILES = """files AS (SELECT user_id AS run_id, event_id, event_type = 'view' AS skipped,
    CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'projection_cache_hit' END AS skip_reason,
    event_type <> 'click' AS output_existed_before_run, CAST(value * 300000 AS BIGINT) AS input_bytes,
    value / 40 AS read_seconds, value / 80 AS conversion_seconds, value / 160 AS write_seconds,
    value / 40 + value / 80 + value / 160 AS total_seconds FROM events)"""


def files(spark, d):
    v, kind = F.col("value"), F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        (kind == "view").alias("skipped"),
        F.when((kind == "view") & (F.col("event_id") % 2 == 0), "projection_cache_hit").alias("skip_reason"),
        (kind != "click").alias("output_existed_before_run"),
        F.round(v * 300000).cast("bigint").alias("input_bytes"),
        (v / 40).alias("read_seconds"),
        (v / 80).alias("conversion_seconds"),
        (v / 160).alias("write_seconds"),
        (v / 40 + v / 80 + v / 160).alias("total_seconds"),
    )


@query(
    "prepare_sub_timing",
    f"""WITH {_FILES} SELECT run_id, round(coalesce(sum(read_seconds) FILTER (NOT skipped), 0), 8) AS per_file_oir_import_seconds,
      round(coalesce(sum(conversion_seconds) FILTER (NOT skipped), 0), 8) AS per_file_z_projection_seconds,
      round(coalesce(sum(write_seconds) FILTER (NOT skipped), 0), 8) AS per_file_tiff_save_seconds FROM files GROUP BY 1""",
)
def _(spark, d):
    out = runs.prepare_sub_timing(files(spark, d))
    return out.select("run_id", *[F.round(c, 8).alias(c) for c in out.columns if c != "run_id"])


@query(
    "investigation_notes",
    f"""WITH {_FILES}, c AS (SELECT run_id, count(*) FILTER (skipped AND skip_reason IS NOT NULL) AS hits,
        count(*) FILTER (output_existed_before_run AND NOT skipped) AS again,
        count(*) FILTER (input_bytes >= 10485760 AND read_seconds >= 1) AS reads, count(*) FILTER (write_seconds >= 1) AS writes,
        count(*) FILTER (NOT skipped AND total_seconds >= 5) AS slow FROM files GROUP BY 1),
      s AS (SELECT c_custkey AS run_id, c_custkey % 4 AS oir, c_custkey % 3 AS tif, c_custkey % 9 AS dirs FROM customer)
      SELECT run_id, concat_ws('|', CASE WHEN oir = 0 THEN 'no_stack_files:0' END, CASE WHEN oir > 0 THEN 'projection_active:0' END,
        CASE WHEN oir > 0 AND tif > 0 THEN 'mixed_types:' || tif END, CASE WHEN oir > 0 AND dirs > 5 THEN 'many_directories:' || dirs END,
        CASE WHEN oir > 0 AND hits > 0 THEN 'cache_hits:' || hits END, CASE WHEN oir > 0 AND again > 0 THEN 'outputs_reprocessed:' || again END,
        CASE WHEN oir > 0 AND reads > 0 THEN 'large_slow_reads:' || reads END, CASE WHEN oir > 0 AND writes > 0 THEN 'slow_writes:' || writes END,
        CASE WHEN oir > 0 AND dirs % 2 = 0 THEN 'engine_note:0' END, CASE WHEN oir > 0 AND slow >= 2 THEN 'slow_files:' || slow END) AS notes
      FROM s LEFT JOIN c USING (run_id)""",
)
def _(spark, d):
    key = F.col("c_custkey")
    scans = table(spark, d, "customer").select(
        key.alias("run_id"),
        (key % 4).alias("oir_count"),
        (key % 3).alias("tiff_count"),
        (key % 9).alias("directories_scanned"),
        F.lit("oir_projection").alias("action"),
        F.when(key % 9 % 2 == 0, "fiji").otherwise("other").alias("engine"),
        F.lit(0.0).alias("projection_seconds"),
    )
    notes = F.transform(
        "notes", lambda n: F.concat(n["code"], F.lit(":"), n["n"].cast("string"))
    )
    return runs.investigation_notes(scans, files(spark, d)).select(
        "run_id", F.array_join(notes, "|").alias("notes")
    )


@query(
    "result_summary",
    """WITH w AS (SELECT user_id AS run_id, count(*) AS n FROM events WHERE value > 100 GROUP BY 1)
      SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS processed_count,
        count(*) FILTER (event_type = 'signup') AS csv_count, count(*) FILTER (event_type = 'error') AS qc_count,
        count(*) FILTER (event_type = 'click') AS masks_count, count(*) FILTER (event_type = 'purchase') AS labels_count,
        coalesce(any_value(n), 0) AS warning_count FROM events LEFT JOIN w ON w.run_id = user_id GROUP BY 1""",
)
def _(spark, d):
    kinds = {"view": "processed", "signup": "measurements", "error": "qc", "click": "masks", "purchase": "labels"}
    mapping = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    events = table(spark, d, "events").withColumnRenamed("user_id", "run_id")
    outputs = events.select("run_id", F.element_at(mapping, F.col("event_type")).alias("kind"))
    return runs.result_summary(outputs, events.filter("value > 100").select("run_id"))


# --- freshness, reconciliation, snapshots ------------------------------------------------------

_CACHE = """out_ AS (SELECT l_orderkey, min(l_shipdate) AS om, CAST(count(*) - 1 AS BIGINT) AS size FROM lineitem GROUP BY 1),
  c AS (SELECT o_orderkey, '/in/img_' || o_orderkey || '.oir' AS input_path, '/out/img_' || o_orderkey || '.tif' AS output_path,
    CASE WHEN o_orderkey % 50 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN om + INTERVAL 1500 MILLISECOND ELSE o_orderdate END END AS im, om, size
    FROM orders LEFT JOIN out_ ON l_orderkey = o_orderkey),
  dec AS (SELECT *, (epoch_us(im) - epoch_us(om)) / 1e6 AS lead FROM c),
  dd AS (SELECT *, CASE WHEN im IS NULL THEN 'input .oir file is missing' WHEN om IS NULL THEN 'expected projected TIFF is missing'
    WHEN size <= 0 THEN 'expected projected TIFF is zero bytes' WHEN lead <= 0 THEN 'output mtime_ns >= input mtime_ns'
    WHEN lead <= 2 THEN printf('output within 2.0s of input mtime (delta=%.3fs)', lead::DOUBLE)
    ELSE printf('input is %.3fs newer than output (>2.0s tolerance)', lead::DOUBLE) END AS reason,
    coalesce(im IS NOT NULL AND size > 0 AND lead <= 2, false) AS is_fresh FROM dec)"""


def cache(spark, d, **options):
    key = F.col("o_orderkey").cast("string")
    outputs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("mtime"), (F.count(F.lit(1)) - 1).alias("size_bytes")
    )
    orders = table(spark, d, "orders").withColumns(
        {
            "input_path": F.concat(F.lit("/in/img_"), key, F.lit(".oir")),
            "output_path": names.projected_path(F.concat(F.lit("/in/img_"), key, F.lit(".oir")), F.lit("/out")),
        }
    )
    mtime = F.when(
        F.col("o_orderkey") % 7 == 0, F.col("mtime") + F.expr("INTERVAL 1 SECOND") + F.expr("INTERVAL '0.5' SECOND")
    ).otherwise(F.col("o_orderdate"))
    inputs = (
        orders.join(outputs, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .filter("o_orderkey % 50 <> 0")
        .select(F.col("input_path").alias("path"), mtime.alias("mtime"))
    )
    made = outputs.select(
        F.concat(F.lit("/out/img_"), F.col("l_orderkey").cast("string"), F.lit(".tif")).alias("path"), "mtime", "size_bytes"
    )
    pairs = orders.select("input_path", "output_path")
    return runs.cache_decisions(pairs, inputs, made, **options)


@query(
    "cache_decisions",
    f"WITH {_CACHE} SELECT input_path, output_path, size AS output_size, is_fresh, reason FROM dd",
)
def _(spark, d):
    return cache(spark, d).select("input_path", "output_path", "output_size", "is_fresh", "reason")


@query(
    "cache_method_changed",
    f"""WITH {_CACHE} SELECT input_path, CASE WHEN im IS NOT NULL AND om IS NOT NULL THEN 'projection method changed (max -> average)'
      ELSE reason END AS reason, false AS is_fresh FROM dd""",
)
def _(spark, d):
    stored = table(spark, d, "region").select(
        F.when(F.col("r_regionkey") == 0, "/out").otherwise("/other").alias("dir"), F.lit("max").alias("method")
    ).distinct()
    return cache(spark, d, method="mean", stored_method=stored).select("input_path", "reason", "is_fresh")


@query("partition_work", f"WITH {_CACHE} SELECT input_path, is_fresh AS cached FROM dd")
def _(spark, d):
    cached, todo = runs.partition_work(cache(spark, d))
    return cached.select("input_path", F.lit(True).alias("cached")).unionByName(
        todo.select("input_path", F.lit(False).alias("cached"))
    )


@query(
    "file_records",
    f"""WITH {LINES}, {_BLOCKS}, {_CACHE} SELECT dd.input_path, 'oir' AS detected_type, size AS output_size,
      CASE WHEN is_fresh THEN 0 ELSE coalesce(read_seconds, 0) END AS read_seconds, is_fresh AS skipped,
      CASE WHEN is_fresh THEN 'projection_cache_hit' END AS skip_reason, om IS NOT NULL AS output_existed_before_run
      FROM dd LEFT JOIN rec ON rec.input_path = dd.input_path""",
)
def _(spark, d):
    timings = logs.parse_file_timings(lines(spark, d))
    return runs.file_records(cache(spark, d), timings, "fiji").select(
        "input_path", "detected_type", "output_size", "read_seconds", "skipped", "skip_reason", "output_existed_before_run"
    )


_RECON = """ex AS (SELECT o_orderkey AS k, '/in/Img_' || o_orderkey || '.oir' AS input_path, '/out/Img_' || o_orderkey || '.tif' AS output_path FROM orders),
  ac AS (SELECT '/out/' || CASE k % 5 WHEN 0 THEN 'Img_' || k || '.tif' WHEN 1 THEN 'Img_' || k || '.tiff' WHEN 2 THEN 'img_' || k || '.tif'
    ELSE 'other_' || k || '.tif' END AS path FROM ex WHERE k % 5 < 3 OR k % 10 = 3
    UNION ALL SELECT '/out/IMG_' || k || '.tiff' FROM ex WHERE k % 35 = 2)"""


@query(
    "reconcile_outputs",
    f"""WITH {_RECON}, l AS (SELECT *, row_number() OVER (ORDER BY input_path) AS rn FROM ex WHERE k % 5 > 2),
      u AS (SELECT path, row_number() OVER (ORDER BY path) AS rn FROM ac WHERE path LIKE '/out/other%'
        OR path IN (SELECT '/out/IMG_' || k || '.tiff' FROM ex WHERE k % 35 = 2) OR path IN (SELECT '/out/img_' || k || '.tif' FROM ex WHERE k % 35 = 2)),
      r AS (SELECT k, path AS source_path, CASE WHEN path IS NULL THEN 'missing' ELSE 'positional' END AS match_kind FROM l LEFT JOIN u USING (rn))
      SELECT input_path, CASE WHEN k % 5 = 0 THEN output_path WHEN k % 5 = 1 THEN output_path || 'f' WHEN k % 35 = 2 THEN NULL
          WHEN k % 5 = 2 THEN '/out/img_' || k || '.tif' ELSE source_path END AS source_path,
        CASE WHEN k % 5 = 0 THEN 'exact' WHEN k % 5 = 1 THEN 'stem' WHEN k % 35 = 2 THEN 'ambiguous' WHEN k % 5 = 2 THEN 'stem_ci'
          ELSE match_kind END AS match_kind FROM ex LEFT JOIN r USING (k)""",
)
def _(spark, d):
    n = F.col("o_orderkey")
    key = n.cast("string")
    orders = table(spark, d, "orders")
    expected = orders.select(
        F.concat(F.lit("/in/Img_"), key, F.lit(".oir")).alias("input_path"),
        F.concat(F.lit("/out/Img_"), key, F.lit(".tif")).alias("output_path"),
    )
    name = (
        F.when(n % 5 == 0, F.concat(F.lit("Img_"), key, F.lit(".tif")))
        .when(n % 5 == 1, F.concat(F.lit("Img_"), key, F.lit(".tiff")))
        .when(n % 5 == 2, F.concat(F.lit("img_"), key, F.lit(".tif")))
        .otherwise(F.concat(F.lit("other_"), key, F.lit(".tif")))
    )
    actual = (
        orders.filter((n % 5 < 3) | (n % 10 == 3))
        .select(F.concat(F.lit("/out/"), name).alias("path"))
        .unionByName(
            orders.filter(n % 35 == 2).select(
                F.concat(F.lit("/out/IMG_"), key, F.lit(".tiff")).alias("path")
            )
        )
    )
    return runs.reconcile_outputs(expected, actual).select("input_path", "source_path", "match_kind")


@query(
    "latest_stage",
    """SELECT user_id AS run_id, 'workflow_end' AS stage, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id
      FROM events WHERE event_type = 'purchase' GROUP BY 1""",
)
def _(spark, d):
    snapshots = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "workflow_end").otherwise("workflow_start").alias("stage"),
        "ts",
        "event_id",
    )
    return runs.latest_stage(snapshots).select("run_id", "stage", "ts", "event_id")


@query(
    "snapshot_diff",
    """WITH p AS (SELECT user_id AS key, '/o' || (user_id % 2) AS dir, '/o/' || (event_id % 40) AS path FROM events WHERE event_type = 'view'),
      c AS (SELECT user_id AS key, '/o' || (user_id % 3) AS dir, '/o/' || (event_id % 40) AS path FROM events WHERE event_type <> 'view')
      SELECT DISTINCT key, 'missing' AS change, path FROM p ANTI JOIN c USING (key, path)
      UNION ALL SELECT DISTINCT p.key, 'dir_changed', c.dir FROM p JOIN c ON p.key = c.key WHERE p.dir <> c.dir""",
)
def _(spark, d):
    events = table(spark, d, "events")

    def listing(df, k):
        return df.select(
            F.col("user_id").alias("key"),
            F.concat(F.lit("/o"), (F.col("user_id") % k).cast("string")).alias("dir"),
            F.concat(F.lit("/o/"), (F.col("event_id") % 40).cast("string")).alias("path"),
        )

    return runs.snapshot_diff(
        listing(events.filter("event_type = 'view'"), 2), listing(events.filter("event_type <> 'view'"), 3)
    )


@query(
    "attach_by_name",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'img_' || o_orderkey || '_mask.tif' END AS mask_name,
      CASE WHEN o_orderkey % 3 = 0 THEN 'img_' || o_orderkey || '_labels.tif' END AS label_name,
      o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 AS skipped FROM orders""",
)
def _(spark, d):
    n = F.col("o_orderkey")
    stem = F.concat(F.lit("img_"), n.cast("string"))
    orders = table(spark, d, "orders").select("o_orderkey")
    made = (
        orders.filter(n % 2 == 0)
        .select(F.concat(stem, F.lit("_mask.tif")).alias("layer_name"))
        .unionByName(orders.filter(n % 3 == 0).select(F.concat(stem, F.lit("_labels.tif")).alias("layer_name")))
    )
    return layers.attach_by_name(orders, made, stem)
