import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelframe import workers
from pixelframe.llm.workers import _joined, map_slices

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(spark):
    texts = spark.range(0, 64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 18).alias("text"))  # 16 MB in one partition

    def size(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return [r.n << 18 for r in map_slices(texts, size, "n bigint").collect()]


def test_a_worker_is_sent_a_few_mb_at_once(spark):
    before = spark.conf.get(SETTING, None)
    try:
        spark.conf.unset(SETTING)
        sizes = batch_sizes(spark)
        assert sum(sizes) == 1 << 24 and max(sizes) <= workers.BATCH_BYTES + (1 << 18)
        spark.conf.set(SETTING, str(1 << 23))  # a limit of the session's own stays
        assert max(batch_sizes(spark)) > workers.BATCH_BYTES + (1 << 18)
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def resident_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10


def test_a_slice_gives_back_what_it_took():
    pieces = [np.ones(1_000) for _ in range(20_000)]  # 160 MB, each below malloc's threshold for pages of its own
    pins = pieces[::2000] + pieces[-1:]  # so the heap cannot shrink from its end
    full = resident_mb()
    del pieces
    _joined([pa.array([0])])
    assert len(pins) == 11 and resident_mb() < full - 100
