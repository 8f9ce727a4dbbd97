import datetime as dt

import pytest
from pyspark.sql import functions as F

from pixelframe.operators import logs, runs, tables
from pixelframe.operators.ranking import ordinal
from pixelframe.sources.inventory import detect_images, file_inventory, scan_summary
from pixelframe.operators.layers import organize_layers
from pixelframe.sources.logs import prefer_files, read_run_logs
from pixelframe.sources.sinks import write_layers, write_measurements, write_report
from pixelframe.sources.tables import load_measurement_tables, read_table


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


FULL = {
    "MyExpt_Image": "ImageNumber,FileName,Count_Cells\n1,testimage.tif,2\n",
    "MyExpt_IdentifyPrimaryObjects": "ImageNumber,ObjectNumber,AreaShape_Area\n1,1,120\n1,2,95\n",
    "MyExpt_Experiment": "Image_Number,Plate_Name\n1,Plate1\n",
}
LEGACY = {
    "MyExpt_IdentifyPrimaryObjects": "ObjectNumber,AreaShape_Area\n1,120\n2,95\n",
    "MyExpt_Image": "Image_Number,FileName\n1,a.tif\n",
}


def test_load_and_merge(spark, tmp_path):
    loaded = load_measurement_tables(spark, write(tmp_path / "full", **FULL))
    merged, warnings = tables.merge_measurements(loaded.tables)
    assert not warnings and merged.count() == 2
    assert {"AreaShape_Area", "FileName", "Plate_Name"} <= set(merged.columns)
    assert any("ImageNumber -> Image_Number" in w for w in loaded.warnings)
    kinds = {r["table"]: r["table_type"] for r in loaded.catalog.collect()}
    assert kinds["MyExpt_Experiment"] == "experiment" and kinds["MyExpt_Image"] == "image"
    names = tables.processed_image_names(loaded.tables).collect()
    assert [r["name"] for r in names] == ["testimage.tif"]


def test_legacy_tables(spark, tmp_path):
    folder = write(tmp_path / "legacy", **LEGACY)
    loaded = load_measurement_tables(spark, folder)
    merged, _ = tables.merge_measurements(loaded.tables)
    assert merged.columns == ["Image_Number", "FileName"]
    kinds = {r["table"]: r["table_type"] for r in loaded.catalog.collect()}
    assert kinds["MyExpt_IdentifyPrimaryObjects"] == "non_standard"
    with pytest.raises(ValueError, match="Image_Number"):
        load_measurement_tables(spark, folder, strict=True)


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_measurement_tables(spark, str(tmp_path / "none"))
    assert load_measurement_tables(spark, str(tmp_path / "none"), lenient=True).warnings
    assert tables.merge_measurements({}) == (None, ["no tables to merge"])


def test_merge_rules(spark):
    image = spark.createDataFrame([(1, "a.tif"), (None, "n.tif")], "Image_Number bigint, FileName string")
    plate = spark.createDataFrame([(1, "P"), (None, "Q")], "Image_Number bigint, Plate_Name string")
    merged = tables.merge_image_tables({"E_Image": image, "E_Experiment": plate})
    assert merged.columns == ["Image_Number", "FileName", "Plate_Name"]
    assert {tuple(r) for r in merged.collect()} == {(1, "a.tif", "P"), (None, "n.tif", "Q")}
    twice = tables.merge_image_tables({"A": image, "B": image, "C": image})
    assert twice.columns == ["Image_Number", "FileName", "FileName_B", "FileName_C"]
    with pytest.raises(ValueError, match="duplicate"):
        tables.merge_image_tables({"A": image.withColumnRenamed("FileName", "x_B").withColumn("x", F.lit(1)),
                                   "B": plate.withColumnRenamed("Plate_Name", "x")})


def log(spark, *lines, run="r"):
    rows = [(run, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "run_id string, pos bigint, line string")


def errors(df):
    return [r["line"] for r in logs.extract_run_errors(df).orderBy("section", "pos").collect()]


def test_error_extraction(spark):
    module = "Encountered error in module IdentifyPrimaryObjects"
    got = errors(log(spark, "Running pipeline", module, "Traceback (most recent call last):",
                     '  File "x.py", line 1', "KeyError: 'DNA'"))
    assert got == [module, "KeyError: 'DNA'"]
    module = "Error detected during run of module SaveImages"
    last = "AssertionError: Feature FileName_OriginalImage does not exist"
    assert errors(log(spark, "Times reported are CPU seconds", module, "Traceback (most recent call last):", last)) == [module, last]
    assert errors(log(spark, "worker exception b", "unable to complete a", "worker exception b")) == [
        "worker exception b", "unable to complete a"]
    assert errors(log(spark, "all fine")) == []


def test_run_success(spark):
    runs_ = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "run_id string, exit_code int")
    lines = log(spark, "Failed to load pipeline", run="a").union(log(spark, "Times reported are CPU", run="b"))
    got = {r["run_id"]: r["succeeded"] for r in logs.run_succeeded(runs_, lines).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_file_timings_across_chunks(spark):
    text = ["noise", "[OIR] input path: C:/data/sample.oir", "[OIR] timing read_seconds: 12.5",
            "[OIR] timing conversion_seconds: 1.2", "[OIR] saveAs target: C:/out/a.tif",
            "[OIR] timing write_seconds: 0.8", "[OIR] saved file verified on disk: C:/out/b.tif"]
    rows = [("r", i * 70_000, line) for i, line in enumerate(text)]  # every line in its own chunk
    df = spark.createDataFrame(rows, "run_id string, pos bigint, line string")
    (row,) = logs.parse_file_timings(df).collect()
    assert row["input_path"] == "C:/data/sample.oir" and row["output_path"] == "C:/out/b.tif"
    assert row["total_seconds"] == pytest.approx(14.5)


def test_log_files_keep_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(3000)))
    (tmp_path / "b.log").write_text("one\r\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_run_logs(spark, str(tmp_path)).orderBy("file", "pos")
        got = [r["line"] for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {i}" for i in range(3000)] + ["one", "two"]


def test_stage_timings(spark):
    rows = [("config_validation_seconds", 0.5), ("cellprofiler_startup_seconds", 1.0),
            ("cellprofiler_subprocess_seconds", 9.0), ("fiji_startup_seconds", 2.0),
            ("fiji_subprocess_seconds", 3.0), ("fiji_postprocess_seconds", 0.5), ("qc_seconds", 1.0),
            ("final_cleanup_seconds", 0.2), ("total_seconds", 15.0)]
    df = spark.createDataFrame([("r", k, v) for k, v in rows], "run_id string, stage string, seconds double")
    row = runs.workflow_timing(df).first()
    assert (row["cellprofiler_seconds"], row["fiji_export_seconds"], row["unaccounted_seconds"]) == (10.0, 5.5, 0.0)
    lines = [r["line"] for r in runs.timing_breakdown(df).orderBy("line_no").collect()]
    assert lines[0] == "Workflow timing breakdown:" and lines[-1] == "  total: 15.00s"


def test_cache(spark):
    t = dt.datetime(2024, 1, 1)
    names = ["fresh", "near", "stale", "empty", "none"]
    pairs = spark.createDataFrame([(f"/i/{n}.oir", f"/o/{n}.tif") for n in names], "input_path string, output_path string")
    delta = {"fresh": 0, "near": 1, "stale": 3, "empty": 0, "none": 0}
    inputs = spark.createDataFrame([(f"/i/{n}.oir", t + dt.timedelta(seconds=delta[n])) for n in names], "path string, mtime timestamp")
    outputs = spark.createDataFrame([(f"/o/{n}.tif", t, 0 if n == "empty" else 9) for n in names[:4]],
                                    "path string, mtime timestamp, size_bytes bigint")
    got = {r["input_path"][3:-4]: r for r in runs.cache_decisions(pairs, inputs, outputs).collect()}
    assert [got[n]["is_fresh"] for n in names] == [True, True, False, False, False]
    assert got["near"]["reason"] == "output within 2.0s of input mtime (delta=1.000s)"
    assert not any(r["is_fresh"] for r in runs.cache_decisions(pairs, inputs, outputs, force=True).collect())


def test_reconcile_positional(spark):
    expected = spark.createDataFrame([("/in/DQMI+4CHI+Ploy A_0007.oir", "/o/DQMI+4CHI+Ploy A_0007.tif")],
                                     "input_path string, output_path string")
    actual = spark.createDataFrame([("/o/alternate_name.tif",)], "path string")
    row = runs.reconcile_outputs(expected, actual).first()
    assert (row["source_path"], row["match_kind"], row["failed"]) == ("/o/alternate_name.tif", "positional", False)


def test_snapshot_diff(spark):
    schema = "key string, dir string, path string"
    before = spark.createDataFrame([("r", "/o", "/o/a.tif"), ("r", "/o", "/o/b.tif"), ("e", "/x", None)], schema)
    now = spark.createDataFrame([("r", "/o", None), ("e", "/y", None)], schema)
    got = sorted((r["change"], r["path"]) for r in runs.snapshot_diff(before, now).collect())
    assert got == [("missing", "/o/a.tif"), ("missing", "/o/b.tif")]


def test_inventory(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for name in ("b.tif", "B.TIFF", "a.png", "sub/deep.oir", "sub/no.tif", "note.txt"):
        (root / name).write_bytes(b"x")
    listed = file_inventory(spark, str(root))
    row = scan_summary(listed).first()
    assert (row["oir_count"], row["tiff_count"], row["directories_scanned"]) == (1, 2, 2)
    found = [r["name"] for r in detect_images(listed).orderBy("priority", "name").collect()]
    assert found == ["b.tif", "B.TIFF", "a.png", "deep.oir"]


def test_ordinal_spreads_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                  (F.col("id") * 7 % 5003).alias("v"))
    hot = ordinal(df, ["k"], ["v"], "n").filter("k = 'hot'").orderBy("v").collect()
    assert [r["n"] for r in hot] == list(range(1, len(hot) + 1))


def test_sinks(spark, tmp_path):
    objects = spark.createDataFrame([("a", 1, 9.0)], "image_id string, label int, centroid_0 double")
    write_measurements(objects, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["image_id", "label", "centroid-0"]
    write_report(objects.withColumn("part", F.lit(None).cast("string")), str(tmp_path / "json"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(lines) == 1 and '"part":null' in lines[0]


def test_indented_log_lines(spark):
    lines = ["Traceback (most recent call last):", "\tKeyError: x", "\tat java.lang.Foo \t", "[OIR] input path:\tC:/a.oir\t", "\t[OIR] timing read_seconds:\t2.5"]
    df = spark.createDataFrame([("r", i, line) for i, line in enumerate(lines)], "run_id string, pos int, line string")
    assert [r["line"] for r in logs.extract_run_errors(df).collect()] == ["KeyError: x"]
    assert [r["line"] for r in logs.extract_marker_errors(df).collect()] == ["at java.lang.Foo"]
    record = logs.parse_file_timings(df).first()
    assert (record["input_path"], record["read_seconds"]) == ("C:/a.oir", 2.5)


def test_cells_with_quotes_line_breaks_and_missing_words(spark, tmp_path):
    text = 'Key,Value,Number,Flag\na,"two\nlines, ""quoted""",NA,True\nb,n/a,2.5,false\nc,,3,NULL\n'
    (tmp_path / "T.csv").write_text(text)
    df = read_table(spark, str(tmp_path / "T.csv"))
    assert dict(df.dtypes)["Number"] == "double" and dict(df.dtypes)["Flag"] == "boolean"
    got = [tuple(r) for r in df.orderBy("Key").collect()]
    assert got == [("a", 'two\nlines, "quoted"', None, True), ("b", None, 2.5, False), ("c", None, 3.0, None)]


def test_layers_are_routed_and_written(spark, tmp_path):
    rows = [("a_mask.tif", [1.0, 0.0]), ("b_objects.tif", [1.0, 2.0]), ("c.tif", [0.0, 1.0]), ("d.tif", [5.0, 7.5])]
    df = spark.createDataFrame(
        [(n, "s", i, n, "float64", p) for i, (n, p) in enumerate(rows)],
        "filename string, stack_id string, frame_index int, source_path string, dtype string, pixels array<double>",
    )
    routed = organize_layers(df)
    names = {k: sorted(r["filename"] for r in v.collect()) for k, v in routed.items()}
    assert names == {"masks": ["a_mask.tif", "c.tif"], "labels": ["b_objects.tif"], "intensity": ["d.tif"]}
    write_layers(routed["masks"], "mask", str(tmp_path / "layers"))
    back = spark.read.parquet(str(tmp_path / "layers")).orderBy("layer_name").collect()
    assert [(r["kind"], r["layer_name"]) for r in back] == [("mask", "a_mask_f000_mask.tif"), ("mask", "c_f002_mask.tif")]


def test_files_win_over_captured_text(spark):
    schema = "run_id string, stream string, line string"
    files = spark.createDataFrame([("r1", "out", "disk")], schema)
    captured = spark.createDataFrame([("r1", "out", "memory"), ("r1", "err", "memory"), ("r2", "out", "memory")], schema)
    got = sorted(map(tuple, prefer_files(files, captured).collect()))
    assert got == [("r1", "err", "memory"), ("r1", "out", "disk"), ("r2", "out", "memory")]


def test_layers_are_found_by_their_rarest_gram(spark):
    """Against every pair of names: repeated names, one-letter and empty stems, non-Latin letters, hot words, nulls."""
    import random

    from pixelframe.operators.layers import match_outputs

    rng = random.Random(4)
    words = ["", "a", "img", "img_0", "cell_β", "plate", "plate_01", "x" * 17, "ab", "ba", "abab"]
    stems = {rng.choice(words) + rng.choice(words) + rng.choice(["", "_1", "_22", "é"]) for _ in range(40)} | {"", "a"}
    images = [(f"{s}.oir" if s else "",) for s in sorted(stems)] + [("img.oir",), (None,)]
    paths = [f"/out/{rng.randrange(3)}/{rng.choice(words)}{rng.choice(words)}{rng.randrange(30)}{rng.choice(['.tif', '.tiff', '.TIFF'])}" for _ in range(150)]
    paths += ["/out/img.tiff", "/other/img.tif"]
    layers = [(p,) for p in [*paths, None]]
    found = match_outputs(spark.createDataFrame(images, "image_name string"), spark.createDataFrame(layers, "layer_path string"))

    def cut(path):
        name = path.rsplit("/", 1)[-1]
        return name.rsplit(".", 1)[0] if "." in name[1:] else name

    def expected(name):
        if name is None:
            return None
        ranked = sorted(paths, key=lambda p: (p.lower().endswith(".tiff"), p))
        same = [p for p in ranked if cut(p) == cut(name)]
        return next(iter(same + [p for p in ranked if cut(name) in cut(p)]), None)

    got = sorted((r["image_name"] or "", r["layer_path"] or "") for r in found.collect())
    assert got == sorted((n or "", expected(n) or "") for (n,) in images)
    none = spark.createDataFrame([], "layer_path string")
    assert {r["layer_path"] for r in match_outputs(spark.createDataFrame(images, "image_name string"), none).collect()} == {None}
