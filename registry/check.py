"""Compare registered queries with their SQL twins: ``python -m registry.check [sf_dir] [names…]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t),
    )


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.collect(), df.columns)
    if name not in registry.ORACLES:
        return bool(got), f"{len(got)} rows, no SQL twin"
    sql = registry.ORACLES[name]
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(kinds) != sorted(spark_kinds):
        return False, f"columns {sorted(spark_kinds)} vs {sorted(kinds)}"
    bad = {c: (k, kinds[c]) for c, k in spark_kinds.items() if TYPES.get(k, k) != kinds[c]}
    cursor = con.execute(sql)
    want = rows_of(cursor.fetchall(), [c[0] for c in cursor.description])
    if got != want:
        diff = next(((a, b) for a, b in zip(got, want) if a != b), ("", ""))
        n = sum(a != b for a, b in zip(got, want))
        return False, f"rows {len(got)} vs {len(want)}, {n} differ, first {diff[0]} | {diff[1]}"
    if bad:
        return False, f"types differ: {bad}"
    return True, f"{len(got)} rows"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    registry.load_all()
    names = args or list(registry.QUERIES)
    spark, con, failed = session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
