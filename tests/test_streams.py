import datetime as dt
from pathlib import Path

import numpy as np

from pixelframe.streaming.streams import stream_changed_files, stream_measure, stream_new_planes

SCHEMA = "path string, size long, modified timestamp, listed timestamp"


def at(minute):
    return dt.datetime(2024, 5, 1, 12, minute)


def test_changed_files_come_again_and_equal_ones_do_not(spark, tmp_path):
    source, checkpoint = str(tmp_path / "listings"), str(tmp_path / "state")

    def batch(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        seen = []
        listings = spark.readStream.schema(SCHEMA).parquet(source)
        run = (
            stream_changed_files(listings)
            .writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        return sorted((r["path"], r["size"], r["modified"], r["change"]) for r in seen)

    first = [("a", 5, at(1), at(2)), ("b", 6, at(1), at(2)), (None, 1, at(1), at(2)), ("a", 4, at(0), at(1)), ("u", None, None, at(2))]
    assert batch(first) == [("a", 5, at(1), "new"), ("b", 6, at(1), "new"), ("u", None, None, "new")]
    # the query starts anew each time: equal versions stay silent, a rewritten file comes again
    assert batch([("a", 5, at(1), at(4)), ("b", 7, at(3), at(4)), ("u", None, None, at(4))]) == [("b", 7, at(3), "changed")]
    assert batch([("b", 6, at(1), at(3)), ("a", 5, at(1), at(3))]) == []  # late listings
    assert batch([("b", 6, at(1), at(6)), ("b", 6, at(1), at(6)), ("u", 2, at(5), at(6))]) == [
        ("b", 6, at(1), "changed"),
        ("u", 2, at(5), "changed"),
    ]
    assert batch([]) == []


def test_stream_measure_leaves_only_its_results(spark, make_planes, tmp_path):
    image = np.zeros((12, 12))
    image[2:8, 3:9] = 9.0
    make_planes({"a": image}).write.parquet(str(tmp_path / "planes"))
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "pixelframe"
    before = set(shared.glob("*")) if shared.exists() else set()
    out = str(tmp_path / "out")
    run = stream_measure(stream_new_planes(spark, str(tmp_path / "planes")), out, str(tmp_path / "state"), min_object_size=3)
    run.awaitTermination()
    assert spark.read.parquet(f"{out}/measurements").count() == 1
    assert set(shared.glob("*")) <= before
