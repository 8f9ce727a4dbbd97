"""Module path of Python workers, and the size of what they are sent at once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of an Arrow batch (and one row), so that executor and worker do not hold a partition's texts at once beside the rows.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let workers find this package; executors need it at the same path or through ``--py-files``.

    Arrow batches of the session get :data:`BATCH_BYTES`, unless it has a limit of its own.
    """
    environment = spark.sparkContext.environment
    if _ROOT not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(x for x in (_ROOT, environment.get("PYTHONPATH")) if x)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
