"""Planes stored whole and in bands give the same results, and no row holds more than a band with its halo."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import bands, histogram, pixelwise, regions, stencil
from pixelframe.plans.pipeline import segment_objects
from pixelframe.sources.planes import scanlines

RNG = np.random.default_rng(17)
LINES = 4


@pytest.fixture(scope="module")
def images():
    tall = RNG.random((23, 9))
    return {
        "tall": tall,
        "exact": RNG.random((8, 5)),  # two full bands
        "short": RNG.random((2, 7)),  # fewer lines than a band
        "line": RNG.random((9, 1)),
        "flat": np.ones((6, 6)),
        "smooth": np.add.outer(np.arange(13.0), np.arange(11.0)) / 24,
    }


def whole(df, column="pixels"):
    return {
        r["image_id"]: np.array(r[column], dtype=object).reshape(r["height"], r["width"])
        for r in df.select("image_id", "height", "width", column).collect()
    }


def joined(df, column="pixels"):
    parts = {}
    for r in df.select("image_id", "y0", "height", "width", column).collect():
        assert r["height"] <= LINES  # the hidden row limit
        parts.setdefault(r["image_id"], []).append((r["y0"], np.array(r[column], dtype=object).reshape(r["height"], r["width"])))
    return {k: np.vstack([a for _, a in sorted(v, key=lambda t: t[0])]) for k, v in parts.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].shape == want[k].shape
        assert np.allclose(got[k].astype(float), want[k].astype(float), rtol=0, atol=1e-9), k


def test_cutting_and_building_from_lines_agree(make_planes, images):
    planes = make_planes(images)
    cut = bands.cut_bands(planes, LINES)
    same(joined(cut), {k: a for k, a in images.items()})
    built = bands.bands_from_lines(scanlines(planes), planes.select("image_id", F.col("height").alias("plane_height")), LINES)
    columns = ["image_id", "plane_height", "width", "band_lines", "band", "y0", "height", "pixels"]
    assert built.select(columns).exceptAll(cut.select(columns)).isEmpty()
    assert cut.select(columns).exceptAll(built.select(columns)).isEmpty()
    with pytest.raises(ValueError):
        bands.cut_bands(planes, 0)


@pytest.mark.parametrize("reach", [0, 3, 9, 50])
def test_halos_are_the_neighbouring_lines_of_the_plane(make_planes, images, reach):
    grown = bands.with_halo(bands.cut_bands(make_planes(images), LINES), reach)
    for r in grown.collect():
        a = images[r["image_id"]]
        top = max(0, r["y0"] - reach)
        end = min(a.shape[0], r["y0"] + r["_own"] + reach)
        assert (r["_top"], r["height"]) == (r["y0"] - top, end - top) and r["height"] <= LINES + 2 * reach
        assert np.array_equal(np.array(r["pixels"]).reshape(r["height"], r["width"]), a[top:end])


STENCILS = [
    (lambda p: stencil.gaussian_blur(p, 1.0), lambda b: bands.gaussian_blur(b, 1.0), "pixels"),
    (lambda p: stencil.gaussian_blur(p, 3.0), lambda b: bands.gaussian_blur(b, 3.0), "pixels"),
    (lambda p: stencil.median_filter(p, 2), lambda b: bands.median_filter(b, 2), "pixels"),
    (lambda p: stencil.rolling_ball_subtract(p, 3), lambda b: bands.rolling_ball_subtract(b, 3), "pixels"),
    (lambda p: stencil.rolling_ball_subtract(p), lambda b: bands.rolling_ball_subtract(b), "pixels"),
    (lambda p: stencil.adaptive_threshold(p, 7, 0.01), lambda b: bands.adaptive_threshold(b, 7, 0.01), "mask"),
    (lambda p: stencil.sauvola_threshold(p, 5), lambda b: bands.sauvola_threshold(b, 5), "mask"),
    (lambda p: stencil.sauvola_threshold(p, 15, 0.3, 0.5), lambda b: bands.sauvola_threshold(b, 15, 0.3, 0.5), "mask"),
    (lambda p: stencil.integral_image(p), lambda b: bands.integral_image(b), "integral"),
    (lambda p: histogram.otsu_threshold(p), lambda b: bands.otsu_threshold(b), "mask"),
]


@pytest.mark.parametrize("case", range(len(STENCILS)))
def test_operators_agree_on_whole_and_banded_planes(make_planes, images, case):
    on_planes, on_bands, column = STENCILS[case]
    planes = make_planes({k: a for k, a in images.items() if k != "flat" or column != "mask"})
    same(joined(on_bands(bands.cut_bands(planes, LINES)), column), whole(on_planes(planes), column))


def test_opening_keeps_the_border_rule_at_the_plane_only(make_planes, images):
    planes = pixelwise.manual_threshold(make_planes(images), 0.25)
    want = whole(stencil.binary_opening(planes), "mask")
    same(joined(bands.binary_opening(bands.cut_bands(planes, LINES)), "mask"), want)


def test_integer_planes_truncate_and_keep_one_bin_per_value(make_planes):
    planes = make_planes({"i": RNG.integers(0, 90, (14, 6)).astype(float)}, dtype="uint8")
    cut = bands.cut_bands(planes, LINES)
    same(joined(bands.gaussian_blur(cut, 1.5)), whole(stencil.gaussian_blur(planes, 1.5)))
    order = ["image_id", "bin", "center", "n"]
    got = bands.intensity_histogram(cut).select(order).orderBy(order).collect()
    assert got == histogram.intensity_histogram(planes).select(order).orderBy(order).collect()
    assert bands.otsu_value(cut).collect() == histogram.otsu_value(planes).collect()


def test_labels_cross_seams(make_planes, images):
    spiral = np.zeros((19, 19))
    for i in range(0, 10, 4):  # open rings joined by a stalk: one object over all bands
        spiral[i, i : 19 - i] = spiral[18 - i, i : 19 - i] = 1
        spiral[i : 19 - i, i] = spiral[i : 19 - i, 18 - i] = 1
    spiral[9, :10] = 1
    planes = pixelwise.manual_threshold(make_planes({**images, "spiral": spiral}), 0.6)
    cut = bands.cut_bands(planes, LINES)
    labels = regions.label_objects(bands.band_runs(cut), 8)
    want = regions.label_objects(regions.mask_runs(planes), 8)
    columns = ["image_id", "height", "width", "y", "x0", "x1", "label"]
    got = sorted(map(tuple, labels.select(columns).collect()))
    assert got == sorted(map(tuple, want.select(columns).collect()))
    painted = joined(bands.paint_labels(cut, labels), "labels")
    expected = {k: np.zeros(a.shape, int) for k, a in {**images, "spiral": spiral}.items()}
    for image, _, _, y, x0, x1, label in got:
        expected[image][y, x0 : x1 + 1] = label
    same(painted, expected)
    assert set(np.unique(painted["spiral"].astype(int))) == {0, 1}


def test_the_default_chain_agrees(make_planes, images):
    planes = make_planes({k: images[k] for k in ("tall", "exact", "smooth")})
    got = bands.segment_bands(bands.cut_bands(planes, LINES), 0.7, 2)
    want = segment_objects(planes, blur_sigma=0.7, min_object_size=2)
    rounded = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect()] for df in (got, want)]
    assert sorted(rounded[0]) == sorted(rounded[1]) and rounded[0]


def test_empty_tables_extra_columns_and_nulls(make_planes):
    planes = make_planes({"a": RNG.random((9, 4))}).withColumn("band_note", F.lit(None).cast("string"))
    empty = bands.cut_bands(planes, LINES).filter("band < 0")
    for made in (bands.gaussian_blur(empty), bands.sauvola_threshold(empty, 3), bands.integral_image(empty), bands.otsu_threshold(empty)):
        assert made.isEmpty()
    assert "band_note" in bands.median_filter(bands.cut_bands(planes, LINES)).columns
    none = planes.withColumn("pixels", F.lit(None).cast("array<double>"))
    assert joined(bands.cut_bands(none, LINES).withColumn("pixels", F.coalesce("pixels", F.array_repeat(F.lit(0.0), F.col("height") * 4))))
    assert [r["pixels"] for r in bands.by_bands(bands.cut_bands(none, LINES), 1, lambda p: p).collect()] == [None] * 3
