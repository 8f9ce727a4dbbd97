"""Loading folders of exported measurement tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions.names import stem
from pixelframe.operators.tables import (
    OBJECT_KEYS,
    check_keys,
    classify_tables,
    merge_keys,
    normalize_columns,
    table_catalog,
)


# Words that stand for a missing cell in exported tables.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass
class LoadedTables:
    tables: dict[str, DataFrame]
    catalog: DataFrame | None
    warnings: list[str] = field(default_factory=list)


def csv_inventory(spark: SparkSession, directory: str, pattern: str = "*.csv") -> DataFrame:
    """``(table, path)`` of the table files in a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(directory)
        .select(stem(F.col("path")).alias("table"), "path")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One exported CSV with normalised columns and 64-bit key columns."""
    df, _ = normalize_columns(_read_csv(spark, path), path)
    return df


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    df = _typed(raw)
    keys = [c for c in (*OBJECT_KEYS, "ImageNumber") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("bigint") for c in keys}) if keys else df


def _typed(raw: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers or truth values where every value that is not missing is one."""
    places = [f"_{i}" for i in range(len(raw.columns))]
    cells = raw.toDF(*places)
    cells = cells.select(*[F.when(~F.trim(c).isin(*MISSING), F.col(c)).alias(c) for c in places])
    kinds = ("bigint", "double", "boolean")
    odd = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias(f"{c}_{k}") for c in places for k in kinds]
    some = [F.count(c).alias(c) for c in places]
    seen = cells.agg(*odd, *some).first() if places else {}
    types = {c: next((k for k in kinds if seen[c] and not seen[f"{c}_{k}"]), "string") for c in places}
    return cells.select(*[F.col(c).cast(types[c]).alias(name) for c, name in zip(places, raw.columns)])


def load_measurement_tables(
    spark: SparkSession,
    directory: str,
    pattern: str = "*.csv",
    strict: bool = False,
    lenient: bool = False,
) -> LoadedTables:
    """Every table file of a folder, classified.

    A missing or empty folder is an error, or a warning with ``lenient``. ``strict`` rejects
    tables that lack the keys of their kind. Only file names reach the driver.
    """
    try:
        files = {r["table"]: r["path"] for r in csv_inventory(spark, directory, pattern).collect()}
    except AnalysisException as error:
        if lenient:
            return LoadedTables({}, None, [f"Measurements directory not found: {directory}"])
        raise FileNotFoundError(f"Output directory not found: {directory}") from error
    if not files:
        message = f"No CSV files matching {pattern!r} in {directory}"
        if lenient:
            return LoadedTables({}, None, [message])
        raise FileNotFoundError(message)

    tables: dict[str, DataFrame] = {}
    warnings: list[str] = []
    for name in sorted(files):
        tables[name], notes = normalize_columns(_read_csv(spark, files[name]), name)
        warnings += notes
    catalog = classify_tables(table_catalog(spark, tables))
    rows = catalog.orderBy("table").collect()  # one row per table
    warnings += [text for row in rows for text in row["warnings"]]
    if strict:
        check_keys(catalog, {row["table"]: merge_keys(row["columns"]) for row in rows if row["legacy"]})
    return LoadedTables(tables, catalog, warnings)
