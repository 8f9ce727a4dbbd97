import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import names
from pixelframe.operators import histogram, layers, measure, pixelwise, stats, stencil
from pixelframe.sources import planes as sources

RNG = np.random.default_rng(3)


def arrays(df, column="pixels"):
    return {
        r["image_id"]: np.array(r[column], dtype=object if column == "mask" else float).reshape(
            r["height"], r["width"]
        )
        for r in df.select("image_id", "height", "width", column).collect()
    }


def gauss(a, sigma, truncate=False):
    radius = int(4 * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * k * k / sigma**2)
    w /= w.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if i == axis else (0, 0) for i in (0, 1)]
        p = np.pad(a, pad, mode="symmetric")
        n = a.shape[axis]
        a = sum(w[j] * np.take(p, np.arange(n) + j, axis=axis) for j in range(len(k)))
        if truncate:
            a = np.trunc(a)
    return a


def test_gaussian_blur_matches_dense_reference(make_planes):
    a, b = RNG.random((12, 9)), RNG.random((3, 5))  # the second is smaller than the kernel
    got = arrays(stencil.gaussian_blur(make_planes({"a": a, "b": b}), 1.5))
    assert np.allclose(got["a"], gauss(a, 1.5)) and np.allclose(got["b"], gauss(b, 1.5))
    ints = RNG.integers(0, 500, (10, 10)).astype(float)
    got = arrays(stencil.gaussian_blur(make_planes({"a": ints}, "uint16"), 1.0))
    assert np.array_equal(got["a"], gauss(ints, 1.0, truncate=True))


def test_blur_edge_cases(make_planes):
    df = make_planes({"a": RNG.random((4, 4))})
    assert stencil.gaussian_blur(df, 0) is df
    with pytest.raises(ValueError, match="sigma"):
        stencil.gaussian_blur(df, -1)


def test_median_removes_isolated_pixel(make_planes):
    a = np.zeros((5, 5))
    a[2, 2] = 255
    assert arrays(stencil.median_filter(make_planes({"a": a}), 1))["a"].max() == 0
    with pytest.raises(ValueError):
        stencil.median_filter(make_planes({"a": a}), -1)


def test_rolling_ball_matches_brute_force(make_planes):
    a, r = RNG.random((14, 11)), 3
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    offsets = [(y, x) for y, x in zip(yy.ravel(), xx.ravel(), strict=True) if y * y + x * x <= r * r]

    def morph(v, f):
        p = np.pad(v, r, mode="symmetric")
        return f([p[r + y : r + y + 14, r + x : r + x + 11] for y, x in offsets], axis=0)

    want = np.clip(a - morph(morph(a, np.min), np.max), 0, None)
    assert np.allclose(arrays(stencil.rolling_ball_subtract(make_planes({"a": a}), r))["a"], want)


def test_rolling_ball_of_any_radius(make_planes):
    """Radii below, at and beyond the side of a plane, against disks taken pixel by pixel."""
    a = np.round(np.random.default_rng(11).random((13, 21)) * 50)
    for r in (1, 3, 7, 16):
        yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
        inside = np.argwhere(np.abs(xx) <= np.floor(np.sqrt(r * r - yy * yy)))

        def extreme(b, pick):
            p = np.pad(b, r, mode="symmetric")
            return np.array([[pick([p[y + j, x + i] for j, i in inside]) for x in range(21)] for y in range(13)])

        want = np.maximum(a - extreme(extreme(a, min), max), 0)
        assert np.allclose(arrays(stencil.rolling_ball_subtract(make_planes({"a": a}), r))["a"], want)


def test_sauvola_matches_brute_force(make_planes):
    a, b = RNG.random((10, 12)), 5
    p = np.pad(a, 2, mode="reflect")
    win = np.stack([p[i : i + 10, j : j + 12] for i in range(b) for j in range(b)])
    want = a > win.mean(0) * (1 + 0.2 * (win.std(0) / a.max() - 1))
    got = arrays(stencil.sauvola_threshold(make_planes({"a": a}), b), "mask")["a"]
    assert np.array_equal(got.astype(bool), want)
    with pytest.raises(ValueError, match="odd"):
        stencil.sauvola_threshold(make_planes({"a": a}), 4)


@pytest.mark.parametrize("shape, b", [((1, 1), 3), ((1, 9), 5), ((9, 1), 5), ((7, 5), 31), ((40, 33), 9)])
def test_sauvola_shapes_blocks_and_bright_planes(make_planes, shape, b):
    a = RNG.random(shape) + 1e6  # small deviations on a bright plane
    r = b // 2
    ys, xs = (np.abs(np.arange(-r, n + r)) for n in shape)
    ys, xs = (np.where(n == 1, 0, i % max(2 * (n - 1), 1)) for i, n in zip((ys, xs), shape))
    ys, xs = (np.where(i < n, i, 2 * (n - 1) - i) for i, n in zip((ys, xs), shape))
    p = a[np.ix_(ys, xs)]
    win = np.stack([p[i : i + shape[0], j : j + shape[1]] for i in range(b) for j in range(b)])
    want = a > win.mean(0) * (1 + 1e-6 * (win.std(0) / 0.25 - 1))
    got = arrays(stencil.sauvola_threshold(make_planes({"a": a}), b, 1e-6, 0.25), "mask")["a"]
    assert np.array_equal(got.astype(bool), want)


def test_sauvola_keeps_odd_values_to_their_windows(make_planes):
    a = RNG.random((12, 11)) + 1
    for odd in (np.nan, np.inf):
        bad = a.copy()
        bad[4, 5] = odd
        clean, got = (
            arrays(stencil.sauvola_threshold(make_planes({"a": v}), 3, r=2.0), "mask")["a"].astype(bool) for v in (a, bad)
        )
        near = np.zeros((12, 11), bool)
        near[3:6, 4:7] = True
        assert not got[near].any() and np.array_equal(got[~near], clean[~near])


def test_integral_image_is_the_sum_of_the_corner(make_planes):
    images = {"a": RNG.random((9, 14)), "line": RNG.random((1, 6)), "one": np.array([[3.0]])}
    got = arrays(stencil.integral_image(make_planes(images)), "integral")
    for name, a in images.items():
        assert np.allclose(got[name], a.cumsum(0).cumsum(1)), name


def test_otsu_constant_and_bimodal(make_planes):
    half = np.zeros((30, 40))
    half[:, 20:] = 200
    df = make_planes({"flat": np.full((4, 4), 7.0), "half": half}, "uint8")
    t = {r["image_id"]: r["threshold"] for r in histogram.otsu_value(df).collect()}
    assert t["flat"] == 7 and 0 <= t["half"] < 200
    masks = arrays(histogram.otsu_threshold(df), "mask")
    assert not masks["flat"].any() and masks["half"].sum() == 600


def test_otsu_takes_the_first_of_equally_good_bins(make_planes):
    """Splits after bin 0 and after bin 128 have the same variance, wherever the plane lies and however it is scaled."""
    bins = np.repeat([0, 127, 128, 255], [5, 1, 1, 5])
    shape = np.where(bins == 0, 0, np.where(bins == 255, 256, bins + 0.5)) / 256
    images = {str(k): (a + b * shape).reshape(3, 4) for k, (a, b) in enumerate(np.random.default_rng(1).random((60, 2)))}
    masks = arrays(histogram.otsu_threshold(make_planes(images)), "mask")
    assert {int(m.sum()) for m in masks.values()} == {7}


@pytest.mark.parametrize(
    "dtype, values, action, check",
    [
        ("float32", [[0, 0.5], [1, 0.25]], "float01_scaled_to_uint16", [[0, 32767], [65535, 16383]]),
        ("float32", [[0, 1234.5], [4095, 65000]], "float_intensity_clipped_to_uint16", [[0, 1234], [4095, 65000]]),
        ("float64", [[0, 50000], [100000, 200000]], "float_intensity_scaled_to_uint16", [[0, 16383], [32767, 65535]]),
        ("uint16", [[1, 2], [3, 4000]], "unchanged_uint16", [[1, 2], [3, 4000]]),
        ("int32", [[-5, 2], [3, 4000]], "integer_clipped_to_uint16", [[0, 2], [3, 4000]]),
    ],
)
def test_to_uint16_goldens(make_planes, dtype, values, action, check):
    out = pixelwise.to_uint16(make_planes({"a": np.array(values)}, dtype))
    assert out.first()["action"] == action
    assert np.array_equal(arrays(out)["a"], np.array(check))


def test_projection_keeps_times_and_channels_apart(spark):
    rng = np.random.default_rng(8)
    voxels = rng.integers(0, 50, (2, 2, 4, 3, 5)).astype(float)  # time, channel, depth, y, x
    rows = [
        (f"{t}{c}{z}", "s", t, c, z, 3, 5, "float64", voxels[t, c, z].ravel().tolist())
        for t, c, z in np.ndindex(2, 2, 4)
    ]
    schema = (
        "image_id string, stack_id string, t_index int, c_index int, z_index int, height int, width int, "
        "dtype string, pixels array<double>"
    )
    df = spark.createDataFrame(rows, schema)
    numpy = dict(max="max", min="min", sum="sum", mean="mean", stdev="std")
    for method, name in [*numpy.items(), ("Median", None)]:
        want = np.median(voxels, axis=2) if name is None else getattr(voxels, name)(axis=2)
        got = np.full(want.shape, np.nan)
        for r in measure.z_project(df, method).collect():
            got[r["t_index"], r["c_index"], r["y"], r["x"]] = r["v"]
        assert np.allclose(got, want), method
    with pytest.raises(ValueError, match="unsupported"):
        measure.z_project(df, "mode")


def test_axes(spark):
    rows = [
        ([8, 9], None, (8, 9, 1, 1, 1, "inferred")),
        ([5, 8, 9], None, (8, 9, 5, 1, 1, "inferred")),
        ([5, 2, 8, 9], None, (8, 9, 5, 1, 2, "inferred")),
        ([3, 5, 2, 8, 9], None, (8, 9, 5, 3, 2, "inferred")),
        ([2, 3, 5, 2, 8, 9], None, (8, 9, 60, 1, 1, "inferred")),
        ([6, 8, 9], {"slices": 3, "channels": 2}, (8, 9, 3, 1, 2, "metadata")),
    ]
    df = spark.createDataFrame([(s, m) for s, m, _ in rows], "shape array<int>, meta map<string,int>")
    got = df.select(sources.interpret_axes(F.col("shape"), F.col("meta")).alias("a")).collect()
    assert [tuple(r["a"]) for r in got] == [w for _, _, w in rows]
    short = spark.createDataFrame([([4],)], "shape array<int>")
    with pytest.raises(Exception, match="at least 2 dimensions"):
        short.select(sources.interpret_axes(F.col("shape"))).collect()


def test_select_plane_out_of_range(make_planes):
    df = make_planes({"a": np.ones((2, 2))}).withColumn("frame_index", F.lit(0))
    assert sources.select_plane(df, 0).count() == 1
    with pytest.raises(Exception, match="out of range"):
        sources.select_plane(df, 1).collect()


def test_first_channel(spark):
    first, last = np.arange(12).reshape(3, 2, 2), np.arange(20).reshape(5, 2, 2)
    df = spark.createDataFrame(
        [("f", [3, 2, 2], first.ravel().tolist()), ("l", [5, 2, 2], last.ravel().tolist())],
        "image_id string, shape array<int>, pixels array<bigint>",
    ).withColumn("pixels", F.col("pixels").cast("array<double>"))
    got = arrays(sources.first_channel(df))
    assert np.array_equal(got["f"], first[0]) and np.array_equal(got["l"], last[..., 0])


def test_layer_kinds(make_planes):
    df = make_planes({"m": np.array([[0, 1], [1, 0]]), "l": np.array([[0, 1, 2], [0, 2, 3]])}, "uint16")
    named = df.withColumn("filename", F.concat("image_id", F.lit(".tif")))
    got = {r["image_id"]: r["kind"] for r in layers.classify_layer(named).collect()}
    assert got == {"m": "mask", "l": "label"}


def test_vignette_and_block_size(make_planes):
    banded = np.full((64, 64), 200.0)
    banded[:10] = banded[-10:] = 80
    assert stats.vignette_score(make_planes({"a": banded})).first()["vignette_score"] > 0.1
    plane = np.zeros((128, 128))
    yy, xx = np.mgrid[:128, :128]
    plane[(yy - 64) ** 2 + (xx - 64) ** 2 <= 100] = 100
    masked = histogram.otsu_threshold(make_planes({"a": plane}, "uint8"))
    assert stats.estimate_block_size(masked).first()["block_size"] == 31


def test_names(spark):
    df = spark.createDataFrame([("/a/b.OIR",), ("/a/x.y.czi",), ("plain",)], "p string")
    got = [r[0] for r in df.select(names.projected_name(F.col("p"))).collect()]
    assert got == ["b.tif", "x.y.tif", "plain.tif"]
    with pytest.raises(Exception, match="unsupported projection method"):
        spark.createDataFrame([("best",)], "m string").select(names.normalize_method(F.col("m"))).collect()


def test_calibration_rejects_non_positive(spark):
    df = spark.createDataFrame([(0.5, 0.25)], "x double, y double")
    r = df.select(pixelwise.pixel_calibration(F.col("x"), F.col("y")).alias("c")).first()["c"]
    assert (r["resolution_x"], r["resolution_y"]) == (2.0, 4.0)
    with pytest.raises(Exception, match="positive"):
        df.select(pixelwise.pixel_calibration(F.col("x") - 1, F.col("y"))).collect()


@pytest.mark.parametrize("few", [1, 7, 1024])
def test_middle_values_match_sorting(spark, few):
    rng = np.random.default_rng(3)
    inf = float("inf")
    groups = {
        "even": rng.normal(size=400),
        "odd": rng.normal(size=401),
        "ties": rng.integers(0, 3, 300).astype(float),
        "same": np.full(50, 2.5),
        "powers": 2.0 ** np.arange(-60, 61),
        "apart": np.array([1.0] * 20 + [2.0] * 20),
        "huge": np.array([-1.7e308, 1.7e308, 3.0, 4.0, 1e308, -1e308, 5.0]),
        "ends": np.array([-inf, inf, inf, 1.0, 2.0, 3.0, np.nan]),
        "tiny": np.array([0.0, 5e-324, 5e-324]),
        "one": np.array([9.0]),
        None: np.array([4.0, 6.0, 7.0, 8.0]),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("even", None), ("nulls", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if k is None else str(k), None if v is None else float(v)) for k, v in rows], "g string, v double")
    got = {r["g"]: r["v"] for r in measure.middle_values(df, ["g"], few).collect()}
    want = {}
    for k, values in groups.items():
        s = np.sort(values)  # NaN last
        a, b = s[(len(s) - 1) // 2], s[len(s) // 2]
        want[k] = a if len(s) % 2 else (a + b) / 2
    assert got == want
    empty = spark.createDataFrame([], df.schema)
    assert measure.middle_values(empty, ["g"], few).collect() == []
