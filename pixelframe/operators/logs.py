"""Queries over run-log lines ``(run_id, pos, line)``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.operators.ranking import running_count

# What log lines look like. They must match the programs that write the logs.
FAILED_RUN_MARKERS = ["failed to load pipeline", "could not find the "]
PIPELINE_ERROR_MARKERS = [
    "failed to load pipeline",
    "could not find the ",
    "error detected during run of module",
    "error in module",
    "exception in module",
    "encountered error",
    "unable to complete",
    "moduleexception",
    "analysisexception",
    "worker exception",
]
MODULE_LINE = (
    r"(?i).*\b(?:error detected during run of|error in|exception in|encountered error in)\s+module\b"
)
EXCEPTION_LINE = r"^[A-Z]\w*(?:Error|Exception)(?::\s*.+)?$"
TRACEBACK = "traceback (most recent call last)"
CONSOLE_ERROR_MARKERS = [
    "VerifyError",
    "File not found:",
    "Import failed:",
    "Open failed:",
    "Unsupported format",
    "Exception in",
    "java.lang.",
]
NO_OUTPUT_TEXT = "Fiji produced no captured console output."
INPUT_PREFIX = "[OIR] input path:"
TARGET_PREFIX = "[OIR] saveAs target:"
VERIFIED_PREFIX = "[OIR] saved file verified on disk:"
READ_PREFIX = "[OIR] timing read_seconds:"
CONVERSION_PREFIX = "[OIR] timing conversion_seconds:"
WRITE_PREFIX = "[OIR] timing write_seconds:"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, markers: list[str]) -> Column:
    """Whether a marker occurs in the text: one alternation, so the text is read once."""
    return text.rlike("|".join(re.escape(m) for m in markers))


def _stripped(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", strip(F.col("line"))).filter(F.col("line") != "")


def extract_run_errors(lines: DataFrame) -> DataFrame:
    """Notable error lines per run: ``(run_id, section, pos, line)``, sorted by section, pos.

    Distinct module lines come first. Runs with a traceback or an exception line add only the
    last exception line; other runs add their distinct marker lines. Frames and headers of
    tracebacks never appear. One partial aggregation on (run, kind, line) carries everything.
    """
    lowered = F.lower("line")
    kind = (
        F.when(lowered.contains(TRACEBACK), "traceback")
        .when(F.col("line").rlike(MODULE_LINE), "module")
        .when(F.col("line").rlike(EXCEPTION_LINE), "exception")
        .when(any_of(lowered, PIPELINE_ERROR_MARKERS), "marker")
    )
    tagged = _stripped(lines).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    distinct = tagged.groupBy("run_id", "kind", "line").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last")
    )

    def seen(name: str) -> Column:
        return F.bool_or(F.col("kind") == name)

    facts = distinct.groupBy("run_id").agg(
        ((seen("traceback") | seen("exception")) & (seen("module") | seen("exception"))).alias(
            "terminal"
        ),
        F.max(F.when(F.col("kind") == "exception", F.col("last"))).alias("last_exception"),
    )
    keep = (
        (F.col("kind") == "module")
        | (F.col("terminal") & (F.col("kind") == "exception") & (F.col("last") == F.col("last_exception")))
        | (~F.col("terminal") & (F.col("kind") == "marker"))
    )
    return (
        distinct.join(facts, "run_id")
        .filter(keep)
        .select(
            "run_id",
            F.when(F.col("kind") == "module", 0).otherwise(1).alias("section"),
            F.when(F.col("kind") == "exception", F.col("last")).otherwise(F.col("first")).alias("pos"),
            "line",
        )
    )


def extract_marker_errors(lines: DataFrame) -> DataFrame:
    """Lines with a console error marker (case-sensitive), order and repeats kept."""
    return _stripped(lines).filter(any_of(F.col("line"), CONSOLE_ERROR_MARKERS))


def _last(lines: DataFrame, n: int, key: str = "run_id") -> DataFrame:
    """Last ``n`` rows per key. Spark keeps only ``n`` rows per key and task before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.desc("pos"))
    return lines.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def error_summary(runs: DataFrame, lines: DataFrame, n: int = 8) -> DataFrame:
    """Last ``n`` error lines per run, else its last ``n`` lines, else one fixed text."""
    errors = _last(extract_marker_errors(lines), n).select("run_id", "pos", "line")
    failing = errors.select("run_id").distinct()
    tail = _last(_stripped(lines), n).select("run_id", "pos", "line")
    other = tail.join(failing, "run_id", "left_anti")
    found = errors.unionByName(other)
    silent = runs.select("run_id").join(_stripped(lines).select("run_id").distinct(), "run_id", "left_anti")
    return found.unionByName(
        silent.select(
            "run_id", F.lit(0).cast(lines.schema["pos"].dataType).alias("pos"), F.lit(NO_OUTPUT_TEXT).alias("line")
        )
    )


def run_succeeded(runs: DataFrame, lines: DataFrame, console: bool = False) -> DataFrame:
    """``(run_id, exit_code, succeeded)``: exit code 0 and no failure marker in the output.

    ``console`` applies the case-sensitive console markers instead of the pipeline ones.
    """
    if console:
        failed = any_of(F.col("line"), CONSOLE_ERROR_MARKERS)
    else:
        failed = any_of(F.lower("line"), FAILED_RUN_MARKERS)
    flags = lines.groupBy("run_id").agg(F.bool_or(failed).alias("_failed"))
    return runs.join(flags, "run_id", "left").select(
        "run_id",
        "exit_code",
        ((F.col("exit_code") == 0) & ~F.coalesce("_failed", F.lit(False))).alias("succeeded"),
    )


def log_tail(lines: DataFrame, n: int = 80, key: str = "file") -> DataFrame:
    return _last(lines, n, key)


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in a stated order; a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def parse_file_timings(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """One record per input block of a conversion log.

    A block starts at an input line; lines before the first one are ignored. Repeated values
    inside a block take the last one, and the output named last wins. Only tagged lines are
    numbered, and numbering carries over between chunks of a long file.
    """
    tagged = lines.withColumn("line", strip(F.col("line"))).filter(F.col("line").startswith("[OIR] "))
    blocks = running_count(
        tagged, [key], "pos", F.col("line").startswith(INPUT_PREFIX), "block"
    ).filter(F.col("block") > 0)
    value = strip(F.element_at(F.split("line", ":", 2), 2))

    def last(prefixes: list[str], number: bool = False) -> Column:
        hit = reduce(lambda a, b: a | b, [F.col("line").startswith(p) for p in prefixes])
        taken = F.max_by(F.when(hit, value), F.when(hit, F.col("pos")))
        return F.coalesce(taken.cast("double"), F.lit(0.0)) if number else taken

    return (
        blocks.groupBy(key, "block")
        .agg(
            last([INPUT_PREFIX]).alias("input_path"),
            last([TARGET_PREFIX, VERIFIED_PREFIX]).alias("output_path"),
            last([READ_PREFIX], True).alias("read_seconds"),
            last([CONVERSION_PREFIX], True).alias("conversion_seconds"),
            last([WRITE_PREFIX], True).alias("write_seconds"),
        )
        .withColumn(
            "total_seconds",
            F.col("read_seconds") + F.col("conversion_seconds") + F.col("write_seconds"),
        )
    )
