import numpy as np
import pytest
from conftest import disk
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.plans import adaptive, pipeline
from pixelframe.streaming import streams

RNG = np.random.default_rng(11)


def test_stages_are_checked_and_chained(make_planes):
    planes = make_planes({"a": np.ones((2, 2))})
    one = pipeline.Stage("copy", ("planes",), ("extra", "more"), lambda p: (p, p.select("image_id")))
    two = pipeline.Stage("again", ("extra",), ("extra",), lambda e: e.limit(0))
    made = pipeline.run_stages([one, two], planes=planes)
    assert set(made) == {"planes", "extra", "more"} and made["extra"].count() == 0
    with pytest.raises(ValueError, match="again: extra"):
        pipeline.run_stages([two], planes=planes)
    with pytest.raises(TypeError, match="copy"):
        pipeline.run_stages([pipeline.Stage("copy", (), ("x",), lambda: None)])
    for bad in ({"blur_sigma": -1}, {"min_object_size": 0}, {"labeling": "other"}):
        with pytest.raises(ValueError):
            pipeline.segmentation(**bad)


def test_batch_with_own_stages(make_planes):
    planes = make_planes({"a": np.ones((2, 2)), "b": np.zeros((2, 2))})
    sizes = pipeline.Stage("sizes", ("planes",), ("sizes",), lambda p: p.select("image_id", F.size("pixels").alias("n")))
    result = pipeline.run_batch(planes, [sizes], overlays=True)
    assert result.measurements is None and result.overlays == {} and set(result.layers) == {"sizes"}
    assert {(r["status"], r["object_count"]) for r in result.summary.collect()} == {("processed", None)}


def test_batch_isolates_bad_images(make_planes, spark):
    image = np.where(disk((32, 32), 10, 10, 5) | disk((32, 32), 24, 22, 4), 200.0, 10.0)
    df = make_planes({"good": image, "bad": image}).withColumn(
        "pixels", F.when(F.col("image_id") == "bad", F.slice("pixels", 1, 5)).otherwise(F.col("pixels"))
    )
    result = pipeline.run_batch(df, overlays=True)
    got = {r["image_id"]: (r["status"], r["object_count"]) for r in result.summary.collect()}
    assert got == {"good": ("processed", 2), "bad": ("failed", None)}
    assert result.failed.first()["error"]
    assert result.overlays["labels"].select(F.size("overlay_r")).first()[0] == 32 * 32
    with pytest.raises(ValueError, match="engine"):
        pipeline.run_analysis(spark, "other")


def test_adaptive_quality_gate(make_planes):
    shape = (96, 96)
    yy, xx = np.mgrid[:96, :96]
    shade = 1 - 0.5 * ((yy - 48) ** 2 + (xx - 48) ** 2) / (2 * 48**2)
    truth = np.zeros(shape, bool)
    for cy, cx in ((25, 25), (25, 70), (70, 25), (70, 70), (48, 48)):
        truth |= disk(shape, cy, cx, 8)
    image = np.round((120 + truth * 500) * shade + RNG.normal(0, 8, shape)).clip(0)
    result = adaptive.adaptive_segment(make_planes({"a": image}, "uint16"))
    mask = np.zeros(shape, bool)
    for r in result.mask.collect():
        mask[r["y"], r["x0"] : r["x1"] + 1] = True
    assert (mask & truth).sum() / (mask | truth).sum() >= 0.5
    row = result.decisions.first()
    assert row["object_count"] >= 4 and row["method"] in ("otsu", "local", "sauvola")


def test_streams(spark, make_planes, tmp_path):
    image = np.where(disk((24, 24), 10, 10, 5), 200.0, 10.0)
    source, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))

    def land(name):
        df = make_planes({name: image}).withColumns(
            {"source_path": F.concat(F.lit("/d/"), "image_id"), "frame_index": F.lit(0), "z_index": F.lit(0),
             "t_index": F.lit(None).cast("int"), "c_index": F.lit(None).cast("int")}
        )
        df.coalesce(1).write.mode("append").parquet(source)

    for name in ("a", "b"):
        land(name)
        streams.stream_measure(streams.stream_new_planes(spark, source), out, mark).awaitTermination()
    done = spark.read.parquet(f"{out}/summary")
    assert sorted((r["image_id"], r["batch"], r["object_count"]) for r in done.collect()) == [("a", 0, 1), ("b", 1, 1)]

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("fine\nError in module M\nKeyError: 'k'\n")
    found = streams.stream_log_errors(spark, str(tmp_path / "logs"))
    query = found.writeStream.format("memory").queryName("log_errors").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["kind"] for r in spark.table("log_errors").collect()} == {"module", "exception"}


def test_analysis_by_both_engines(spark, make_planes, tmp_path):
    image = np.where(disk((32, 32), 10, 10, 5), 200.0, 10.0)
    native = pipeline.run_analysis(spark, planes=make_planes({"a": image}))
    assert native["measurements"].count() == 1 and native["summary"].first()["status"] == "processed"
    (tmp_path / "X_Image.csv").write_text("ImageNumber,FileName\n1,a.tif\n")
    (tmp_path / "X_Cells.csv").write_text("ImageNumber,ObjectNumber,Area\n1,1,5\n1,2,7\n")
    merged = pipeline.run_analysis(spark, "tables", tables_dir=str(tmp_path))
    assert set(merged["tables"]) == {"X_Image", "X_Cells"} and merged["measurements"].count() == 2
    apart = pipeline.run_analysis(spark, "tables", tables_dir=str(tmp_path), merge=False)
    assert apart["measurements"] is None
    for bad in ({"engine": "native"}, {"engine": "tables"}):
        with pytest.raises(ValueError, match="required"):
            pipeline.run_analysis(spark, **bad)


def test_own_python_per_image(make_planes):
    double = pipeline.custom_step(
        make_planes({"a": np.ones((2, 2)), "b": np.zeros((2, 2))}),
        lambda pdf: pdf.assign(total=[2 * float(sum(p)) for p in pdf["pixels"]])[["image_id", "total"]],
        "image_id string, total double",
    )
    assert {tuple(r) for r in double.collect()} == {("a", 8.0), ("b", 0.0)}


def test_adaptive_planes_are_judged_where_they_lie(make_planes, monkeypatch):
    plans = []

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        if len(plans) == 2:
            raise InterruptedError
        return durable(df)

    monkeypatch.setattr(adaptive, "durable", stored)
    with pytest.raises(InterruptedError):
        adaptive.adaptive_segment(make_planes({"a": np.eye(12) * 90}))
    assert not any("Join" in plan for plan in plans)
