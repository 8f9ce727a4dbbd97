"""Bookkeeping of batch runs: timings, freshness, reconciliation, snapshots, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.functions.names import file_type, resolve_method, stem
from pixelframe.operators.ranking import ordinal

# Timing keys in display order, and the keys that are not own work.
TIMING_KEYS = [
    "config_validation_seconds",
    "pipeline_materialization_seconds",
    "setup_directories_seconds",
    "prepare_input_seconds",
    "adaptive_threshold_seconds",
    "cellprofiler_startup_seconds",
    "cellprofiler_subprocess_seconds",
    "cellprofiler_seconds",
    "copy_measurements_seconds",
    "inspect_cp_logs_seconds",
    "load_measurements_seconds",
    "csv_merge_export_seconds",
    "fiji_startup_seconds",
    "fiji_subprocess_seconds",
    "fiji_postprocess_seconds",
    "fiji_export_seconds",
    "qc_seconds",
    "final_cleanup_seconds",
    "unaccounted_seconds",
    "total_seconds",
]
AGGREGATES = {
    "cellprofiler_seconds": ["cellprofiler_startup_seconds", "cellprofiler_subprocess_seconds"],
    "fiji_export_seconds": [
        "fiji_startup_seconds",
        "fiji_subprocess_seconds",
        "fiji_postprocess_seconds",
    ],
}
META_KEYS = ["total_seconds", "unaccounted_seconds"]
BREAKDOWN_TITLE = "Workflow timing breakdown:"

# Freshness tolerance, thresholds of the profile notes and reason texts.
MTIME_TOLERANCE_SECONDS = 2.0
LARGE_READ_BYTES = 10 * 1024 * 1024
SLOW_STEP_SECONDS = 1.0
SLOW_FILE_SECONDS = 5.0
MANY_DIRECTORIES = 5
REASON_FORCED = "force_oir_reproject is True"
REASON_NO_INPUT = "input .oir file is missing"
REASON_NO_OUTPUT = "expected projected TIFF is missing"
REASON_METHOD = "projection method changed (%s -> %s)"
REASON_EMPTY = "expected projected TIFF is zero bytes"
REASON_NEWER = "output mtime_ns >= input mtime_ns"
REASON_TOLERATED = "output within 2.0s of input mtime (delta=%.3fs)"
REASON_STALE = "input is %.3fs newer than output (>2.0s tolerance)"
CACHE_HIT = "projection_cache_hit"


def workflow_timing(stages: DataFrame) -> DataFrame:
    """Per run: the two stage aggregates, total, and time no stage accounts for.

    Conditional sums over ``(run_id, stage, seconds)`` in one aggregation; rows of the meta
    and aggregate keys never count as own work.
    """
    stage, seconds = F.col("stage"), F.col("seconds")

    def sum_of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, seconds)), F.lit(0.0))

    result = stages.groupBy("run_id").agg(
        *[sum_of(stage.isin(*parts)).alias(name) for name, parts in AGGREGATES.items()],
        sum_of(stage == "total_seconds").alias("total_seconds"),
        sum_of(~stage.isin(*META_KEYS, *AGGREGATES)).alias("_accounted"),
    )
    return result.withColumn(
        "unaccounted_seconds",
        F.greatest(F.lit(0.0), F.col("total_seconds") - F.col("_accounted")),
    ).drop("_accounted")


def timing_breakdown(stages: DataFrame) -> DataFrame:
    """Display lines ``(run_id, line_no, line)``: a title, then the known keys in order."""
    keys = F.array(*[F.lit(k) for k in TIMING_KEYS])
    summed = stages.groupBy("run_id", "stage").agg(F.sum("seconds").alias("seconds"))
    known = summed.withColumn("line_no", F.array_position(keys, F.col("stage")).cast("int")).filter(
        F.col("line_no") > 0
    )
    label = F.replace(F.regexp_replace("stage", "_seconds", ""), F.lit("_"), F.lit(" "))
    lines = known.select(
        "run_id", "line_no", F.format_string("  %s: %.2fs", label, F.bround("seconds", 2)).alias("line")
    )
    titles = stages.select("run_id").distinct().select(
        "run_id", F.lit(0).alias("line_no"), F.lit(BREAKDOWN_TITLE).alias("line")
    )
    return titles.unionByName(lines)


def prepare_sub_timing(files: DataFrame) -> DataFrame:
    """Read, convert and write seconds per run over files that were not skipped."""
    done = ~F.col("skipped")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(column))), F.lit(0.0))

    return files.groupBy("run_id").agg(
        total("read_seconds").alias("per_file_oir_import_seconds"),
        total("conversion_seconds").alias("per_file_z_projection_seconds"),
        total("write_seconds").alias("per_file_tiff_save_seconds"),
    )


def investigation_notes(scans: DataFrame, files: DataFrame) -> DataFrame:
    """Why preparing inputs took long: ``(run_id, notes array<struct<code, n>>)``.

    ``scans`` has one row per run (``oir_count, tiff_count, directories_scanned, action,
    engine, projection_seconds``), ``files`` one row per input file. Without stack inputs only
    the pass-through notes apply.
    """
    skipped = F.col("skipped")
    counts = files.groupBy("run_id").agg(
        F.count_if(skipped & (F.col("skip_reason") == CACHE_HIT)).alias("cache_hits"),
        F.count_if(F.col("output_existed_before_run") & ~skipped).alias("reprocessed"),
        F.count_if(
            (F.col("input_bytes") >= LARGE_READ_BYTES) & (F.col("read_seconds") >= SLOW_STEP_SECONDS)
        ).alias("large_reads"),
        F.count_if(F.col("write_seconds") >= SLOW_STEP_SECONDS).alias("slow_writes"),
        F.count_if(~skipped & (F.col("total_seconds") >= SLOW_FILE_SECONDS)).alias("slow_files"),
    )
    zero = F.lit(0).cast("bigint")
    n = {c: F.coalesce(c, zero) for c in counts.columns if c != "run_id"}

    def note(code: str, condition: Column, count: Column = zero) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), count.cast("bigint").alias("n")))

    oir, tiff, dirs = F.col("oir_count"), F.col("tiff_count"), F.col("directories_scanned")
    no_input = F.array(
        note("no_stack_files", F.lit(True)),
        note("unexpected_duration", F.col("projection_seconds") > 0.1),
    )
    with_input = F.array(
        note("projection_active", F.lit(True)),
        note("mixed_types", tiff > 0, tiff),
        note("many_directories", dirs > MANY_DIRECTORIES, dirs),
        note("cache_hits", n["cache_hits"] > 0, n["cache_hits"]),
        note("outputs_reprocessed", n["reprocessed"] > 0, n["reprocessed"]),
        note("large_slow_reads", n["large_reads"] > 0, n["large_reads"]),
        note("slow_writes", n["slow_writes"] > 0, n["slow_writes"]),
        note("all_cache_hits", F.col("action") == "oir_projection_cache_hit"),
        note("engine_note", F.col("engine").isin("fiji", "python")),
        note("slow_files", n["slow_files"] >= 2, n["slow_files"]),
    )
    return scans.join(counts, "run_id", "left").select(
        "run_id", F.array_compact(F.when(oir == 0, no_input).otherwise(with_input)).alias("notes")
    )


def result_summary(outputs: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per run: processed images, table files, overlays, masks, labels and warnings."""
    kinds = {
        "processed": "processed",
        "measurements": "csv",
        "qc": "qc",
        "masks": "masks",
        "labels": "labels",
    }
    counted = outputs.groupBy("run_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{name}_count") for k, name in kinds.items()]
    )
    warned = warnings.groupBy("run_id").agg(F.count(F.lit(1)).alias("warning_count"))
    return counted.join(warned, "run_id", "left").withColumn(
        "warning_count", F.coalesce("warning_count", F.lit(0).cast("bigint"))
    )


def cache_decisions(
    pairs: DataFrame,
    inputs: DataFrame,
    outputs: DataFrame,
    force: bool = False,
    method: str | None = "max",
    stored_method: DataFrame | None = None,
) -> DataFrame:
    """Freshness of every expected projection, with the reason.

    ``pairs (input_path, output_path)``, ``inputs (path, mtime)``, ``outputs (path, mtime,
    size_bytes)``, ``stored_method (dir, method)``. Reasons apply in a fixed order; the method
    check comes before any time is compared.
    """
    requested = resolve_method(method)
    source = inputs.select(F.col("path").alias("input_path"), F.col("mtime").alias("input_mtime"))
    target = outputs.select(
        F.col("path").alias("output_path"),
        F.col("mtime").alias("output_mtime"),
        F.col("size_bytes").alias("output_size"),
    )
    joined = pairs.join(source, "input_path", "left").join(target, "output_path", "left")
    if stored_method is None:
        joined = joined.withColumn("_stored", F.lit(None).cast("string"))
    else:
        joined = joined.withColumn("_dir", F.regexp_replace("output_path", r"/[^/]*$", "")).join(
            stored_method.select(F.col("dir").alias("_dir"), F.col("method").alias("_stored")),
            "_dir",
            "left",
        ).drop("_dir")
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("input_mtime", "output_mtime")]
    lead = (micros[0] - micros[1]) / 1e6
    rules = [
        (F.lit(force), False, F.lit(REASON_FORCED)),
        (F.col("input_mtime").isNull(), False, F.lit(REASON_NO_INPUT)),
        (F.col("output_mtime").isNull(), False, F.lit(REASON_NO_OUTPUT)),
        (
            F.col("_stored") != requested,
            False,
            F.format_string(REASON_METHOD, F.col("_stored"), F.lit(requested)),
        ),
        (F.col("output_size") <= 0, False, F.lit(REASON_EMPTY)),
        (lead <= 0, True, F.lit(REASON_NEWER)),
        (lead <= MTIME_TOLERANCE_SECONDS, True, F.format_string(REASON_TOLERATED, lead)),
    ]
    fresh = F.when(F.lit(False), F.lit(False))
    reason = F.when(F.lit(False), F.lit(""))
    for condition, is_fresh, text in rules:
        fresh = fresh.when(condition, F.lit(is_fresh))
        reason = reason.when(condition, text)
    return joined.select(
        "input_path",
        "output_path",
        F.col("output_mtime").isNotNull().alias("output_exists"),
        "output_size",
        "input_mtime",
        "output_mtime",
        fresh.otherwise(F.lit(False)).alias("is_fresh"),
        F.lit(force).alias("forced"),
        reason.otherwise(F.format_string(REASON_STALE, lead)).alias("reason"),
    )


def partition_work(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached and to-do files; forced decisions are never fresh, so all of them are to do."""
    return decisions.filter("is_fresh"), decisions.filter("not is_fresh")


def file_records(decisions: DataFrame, timings: DataFrame, engine: str) -> DataFrame:
    """One profile record per input: cache hits are skipped, the others carry log timings."""
    seconds = ["read_seconds", "conversion_seconds", "write_seconds", "total_seconds"]
    joined = decisions.join(
        timings.select("input_path", *seconds), "input_path", "left"
    )
    hit = F.col("is_fresh")
    return joined.select(
        "input_path",
        file_type(F.col("input_path")).alias("detected_type"),
        "output_path",
        "output_size",
        *[F.when(hit, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in seconds],
        hit.alias("skipped"),
        F.when(hit, F.lit(CACHE_HIT)).alias("skip_reason"),
        F.col("output_exists").alias("output_existed_before_run"),
        F.lit(engine).alias("engine"),
    )


def reconcile_outputs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Match created files to expected outputs.

    ``expected (input_path, output_path)``, ``actual (path)`` → one row per input with
    ``source_path``, ``match_kind`` (``exact, stem, stem_ci, ambiguous, positional,
    missing``). Stages are anti-joins and equi-joins; leftovers are paired by their distributed
    positions in path order. What a stage decides is stored, so no listing is read again for the next. Inputs that share an expected file share its match, and when two
    stems differ only by case the first path takes the candidate.
    """
    targets = durable(expected.groupBy("output_path").agg(F.min("input_path").alias("input_path")))
    files = durable(actual.select("path").distinct())
    exact = durable(
        targets.join(files, F.col("output_path") == F.col("path"), "left_semi").withColumns(
            {"source_path": F.col("output_path"), "match_kind": F.lit("exact")}
        )
    )
    open1 = targets.join(exact, "output_path", "left_anti")
    free1 = files.join(exact.select(F.col("source_path").alias("path")), "path", "left_anti")

    by_stem = free1.groupBy(stem(F.col("path")).alias("_stem")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("source_path")
    )
    found = open1.withColumn("_stem", stem(F.col("input_path"))).join(by_stem, "_stem")
    same = found.select(
        "output_path",
        "input_path",
        F.when(F.col("_n") == 1, F.col("source_path")).alias("source_path"),
        F.when(F.col("_n") == 1, "stem").otherwise("ambiguous").alias("match_kind"),
    )
    same = durable(same)
    open2 = open1.join(same, "output_path", "left_anti")
    taken = same.filter(F.col("source_path").isNotNull()).select(F.col("source_path").alias("path"))
    free2 = free1.join(taken, "path", "left_anti")

    by_fold = free2.groupBy(F.lower(stem(F.col("path"))).alias("_stem")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("source_path")
    )
    first = (
        open2.groupBy(F.lower(stem(F.col("input_path"))).alias("_stem"))
        .agg(F.min("input_path").alias("_first"))
    )
    folded = (
        open2.withColumn("_stem", F.lower(stem(F.col("input_path"))))
        .join(by_fold, "_stem")
        .join(first, "_stem")
        .filter((F.col("_n") > 1) | (F.col("input_path") == F.col("_first")))
        .select(
            "output_path",
            "input_path",
            F.when(F.col("_n") == 1, F.col("source_path")).alias("source_path"),
            F.when(F.col("_n") == 1, "stem_ci").otherwise("ambiguous").alias("match_kind"),
        )
    )
    folded = durable(folded)
    open3 = open2.join(folded, "output_path", "left_anti")
    taken = folded.filter(F.col("source_path").isNotNull()).select(F.col("source_path").alias("path"))
    free3 = free2.join(taken, "path", "left_anti")

    one = F.lit(0).alias("_all")
    left = ordinal(open3.select("output_path", "input_path", one), ["_all"], ["input_path"], "_rank")
    right = ordinal(free3.select("path", one), ["_all"], ["path"], "_rank")
    rest = left.join(right.select("_rank", "path"), "_rank", "left").select(
        "output_path",
        "input_path",
        F.col("path").alias("source_path"),
        F.when(F.col("path").isNotNull(), "positional").otherwise("missing").alias("match_kind"),
    )
    columns = ["output_path", "source_path", "match_kind"]
    decided = exact.select(*columns)
    for part in (same, folded, rest):
        decided = decided.unionByName(part.select(*columns))
    return expected.join(decided, "output_path").withColumn(
        "failed", F.col("match_kind").isin("ambiguous", "missing")
    )


def latest_stage(snapshots: DataFrame, stage: str = "workflow_end") -> DataFrame:
    """Last snapshot of a stage per run (partial-aggregated maximum, no window).

    Of snapshots at one time the one with the largest other values counts, in order of the columns.
    """
    rest = [c for c in snapshots.columns if c not in ("run_id", "stage", "ts")]
    picked = snapshots.filter(F.col("stage") == stage)
    newest = picked.groupBy("run_id", "stage").agg(F.max(F.struct("ts", *rest)).alias("_s"))
    return newest.select("run_id", "stage", "_s.*")


def snapshot_diff(previous_end: DataFrame, current_start: DataFrame) -> DataFrame:
    """What changed between two listings ``(key, dir, path)``: ``(key, change, path)``.

    ``missing`` rows are paths of the previous end that are gone; ``dir_changed`` marks keys
    whose folder differs. Keys without previous paths report nothing.
    """
    gone = (
        previous_end.filter(F.col("path").isNotNull())
        .join(current_start.select("key", "path"), ["key", "path"], "left_anti")
        .select("key", F.lit("missing").alias("change"), "path")
        .distinct()
    )
    before = (
        previous_end.filter(F.col("path").isNotNull())
        .groupBy("key")
        .agg(F.max("dir").alias("_before"))
    )
    now = current_start.groupBy("key").agg(F.max("dir").alias("_now"))
    moved = (
        before.join(now, "key")
        .filter(F.col("_before") != F.col("_now"))
        .select("key", F.lit("dir_changed").alias("change"), F.col("_now").alias("path"))
    )
    return gone.unionByName(moved)


def imageset_rows(images: DataFrame, channels: list[str], limit: int | None = None) -> DataFrame:
    """Cycle table of the images in order of name: the first channel holds the file name.

    ``limit`` keeps the first ones only. Numbers come from sorted partitions and their offsets, so no task sees
    the whole listing.
    """
    listed = images.select("name", "path")
    if limit is not None:
        listed = listed.orderBy("name", "path").limit(limit)
    columns = [F.col("name").alias(channels[0])]
    columns += [F.lit("").alias(c) for c in channels[1:]]
    return ordinal(listed, [], ["name", "path"], "cycle").select(F.col("cycle").cast("int").alias("cycle"), *columns)
