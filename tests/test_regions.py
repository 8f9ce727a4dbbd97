from collections import deque

import numpy as np
import pytest
from conftest import disk
from pyspark.sql import functions as F

from pixelframe.operators import compare, measure, regions, watershed
from pixelframe.operators.distance import squares

RNG = np.random.default_rng(5)


def bfs(mask, connectivity):
    labels, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if connectivity == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x]:
            continue
        n += 1
        labels[y, x] = n
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                p, q = a + dy, b + dx
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not labels[p, q]:
                    labels[p, q] = n
                    queue.append((p, q))
    return labels


def images(runs, masks, value=None):
    out = {k: np.zeros(m.shape, int) for k, m in masks.items()}
    for r in runs.collect():
        out[r["image_id"]][r["y"], r["x0"] : r["x1"] + 1] = r[value] if value else 1
    return out


def spiral(n):
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    for _ in range(n * n):
        a, b = y + dy, x + dx
        c, e = a + dy, b + dx
        ahead = 0 <= c < n and 0 <= e < n and m[c, e]
        if not (0 <= a < n and 0 <= b < n) or m[a, b] or ahead:
            dy, dx = dx, -dy
            a, b = y + dy, x + dx
            c, e = a + dy, b + dx
            if m[a, b] or (0 <= c < n and 0 <= e < n and m[c, e]):
                break
        y, x = a, b
        m[y, x] = True
    return m


def test_labels_match_bfs(make_masks):
    masks = {f"r{i}": RNG.random((17, 23)) < p for i, p in enumerate((0.3, 0.45, 0.6, 0.8))}
    masks["spiral"] = spiral(21)
    masks["empty"], masks["full"] = np.zeros((5, 6), bool), np.ones((5, 6), bool)
    masks["wide"] = RNG.random((3, 300)) < 0.7  # crosses several tiles
    runs = regions.mask_runs(make_masks(masks))
    for connectivity in (4, 8):
        got = images(regions.label_objects(runs, connectivity), masks, "label")
        for k, m in masks.items():
            assert np.array_equal(got[k], bfs(m, connectivity)), (k, connectivity)
    counts = {r["image_id"]: r["object_count"] for r in regions.count_objects(make_masks(masks), runs).collect()}
    assert counts["empty"] == 0 and counts["full"] == 1


def test_cleaning(make_masks):
    m = np.zeros((14, 14), bool)
    m[:3, :3] = True
    m[5:11, 5:11] = True
    m[6:10, 6:10] = False
    squares = np.zeros((12, 12), bool)
    squares[3:6, 3:6] = squares[7:10, 7:10] = True
    masks = {"ring": m, "squares": squares}
    got = images(regions.clean_mask(regions.mask_runs(make_masks(masks)), 4), masks)
    want = np.zeros((14, 14), int)
    want[5:11, 5:11] = 1
    assert np.array_equal(got["ring"], want) and np.array_equal(got["squares"], squares)


def test_mask_round_trip(make_masks):
    masks = {"a": RNG.random((9, 7)) < 0.5, "none": np.zeros((4, 4), bool)}
    df = make_masks(masks)
    back = regions.runs_to_mask(df, regions.mask_runs(df))
    for r in back.collect():
        assert r["mask"] == masks[r["image_id"]].ravel().tolist()


def test_distance_matches_brute_force(make_masks):
    m = RNG.random((40, 40)) < 0.9
    bg = np.argwhere(~m)
    want = np.array(
        [[np.sqrt(((bg - (y, x)) ** 2).sum(1).min()) for x in range(40)] for y in range(40)]
    )
    row = watershed.distance_transform(make_masks({"a": m})).first()
    assert np.allclose(np.array(row["distance"]).reshape(40, 40), want)


def test_distances_of_many_planes_at_once():
    rng = np.random.default_rng(2)
    for n, h, w, share in ((9, 8, 8, 0.7), (3, 5, 1, 0.6), (3, 1, 9, 0.6), (4, 11, 17, 0.97), (2, 3, 3, 1.0)):
        masks = rng.random((n, h, w)) < share
        yy, xx = np.mgrid[:h, :w]
        for mask, got in zip(masks, squares(masks)):
            off = np.argwhere(~mask)
            far = (yy[..., None] - off[:, 0]) ** 2 + (xx[..., None] - off[:, 1]) ** 2
            assert (got == (far.min(-1) if len(off) else -1)).all()


def test_distance_keeps_columns_and_fills_short_masks(spark):
    rows = [(1, 2, 2, [True, False, True, True], "a"), (2, 1, 3, [True, None], None), (3, 2, 2, None, "c"), (4, 2, 2, [True] * 4, "d")]
    df = spark.createDataFrame(rows, "image_id int, height int, width int, mask array<boolean>, note string").coalesce(1)
    got = {r.image_id: r for r in watershed.distance_transform(df).collect()}
    assert [got[k].note for k in (1, 2, 3, 4)] == ["a", None, "c", "d"] and got[2].mask == [True, None]
    assert got[1].distance == [1.0, 0.0, 2**0.5, 1.0] and got[2].distance == [1.0, 0.0, 0.0]
    assert got[3].distance is None and got[4].distance == [None] * 4


def test_distance_of_odd_shapes(make_masks):
    """Single lines and columns, solid masks with one hole, masks without any background."""
    solid = np.ones((33, 50), bool)
    solid[7, 41] = False
    masks = {"line": RNG.random((1, 37)) < 0.8, "column": RNG.random((29, 1)) < 0.8, "solid": solid, "dot": np.zeros((1, 1), bool)}
    for k, row in {r.image_id: r for r in watershed.distance_transform(make_masks(masks)).collect()}.items():
        bg = np.argwhere(~masks[k])
        h, w = masks[k].shape
        want = [[np.sqrt(((bg - (y, x)) ** 2).sum(1).min()) for x in range(w)] for y in range(h)]
        assert np.allclose(np.array(row["distance"]).reshape(h, w), want)
    full = watershed.distance_transform(make_masks({"full": np.ones((4, 5), bool)})).first()
    assert full["distance"] == [None] * 20


def test_touching_disks_split(make_masks):
    touching = disk((40, 40), 20, 12, 8) | disk((40, 40), 20, 28, 8)
    apart = disk((40, 40), 12, 12, 7) | disk((40, 40), 28, 28, 7)
    masks = {"touching": touching, "apart": apart, "empty": np.zeros((6, 6), bool)}
    got = images(watershed.split_touching(make_masks(masks)), masks, "label")
    assert set(np.unique(got["touching"])) == {0, 1, 2}
    assert np.array_equal(got["touching"] > 0, touching)
    assert set(np.unique(got["apart"])) == {0, 1, 2} and np.array_equal(got["apart"] > 0, apart)
    assert not got["empty"].any()


def test_measurements(make_masks, make_planes):
    m = np.zeros((8, 8), bool)
    m[1:4, 1:4] = True
    a = np.where(m, 200.0, 3.0)
    out = measure.measurements_from_mask(regions.mask_runs(make_masks({"a": m})), make_planes({"a": a}))
    row = out.first()
    assert (row["area"], row["centroid_0"], row["centroid_1"]) == (9.0, 2.0, 2.0)
    assert (row["bbox_0"], row["bbox_1"], row["bbox_2"], row["bbox_3"]) == (1, 1, 4, 4)
    assert row["mean_intensity"] == row["max_intensity"] == 200
    bare = measure.measurements_from_mask(regions.mask_runs(make_masks({"a": m})))
    assert "mean_intensity" not in bare.columns
    assert "bbox-3" in measure.export_names(out).columns


def test_compare_masks(make_masks):
    e, f = np.zeros((4, 4), bool), np.ones((4, 4), bool)
    same = compare.compare_masks(make_masks({"a": e}), make_masks({"a": e}), objects=False).first()
    assert (same["iou"], same["dice"], same["pixel_agreement"]) == (1.0, 1.0, 1.0)
    none = compare.compare_masks(make_masks({"a": e}), make_masks({"a": f}), objects=False).first()
    assert (none["iou"], none["dice"], none["pixel_agreement"]) == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="do not match"):
        compare.compare_masks(make_masks({"a": e}), make_masks({"a": f[:2]}), objects=False).collect()


def kruskal(field, seeds):
    """Markers grown over a spanning forest: links deepest first, ties in raster order, none between two markers."""
    h, w = field.shape
    at = [(y, x) for y in range(h) for x in range(w) if field[y, x] > 0]
    part = {p: ("m", seeds[p]) if p in seeds else ("p", p) for p in at}
    links = []
    for y, x in at:
        for q in ((y, x + 1), (y + 1, x)):
            if q in part:
                links.append((max(-field[y, x], -field[q]), (y, x), q))
    for _, p, q in sorted(links):
        a, b = sorted((part[p], part[q]))
        if a != b and not (a[0] == b[0] == "m"):
            for k, v in part.items():
                if v == b:
                    part[k] = a
    return {p: v[1] for p, v in part.items() if v[0] == "m"}


def test_flood_forest_against_kruskal(spark):
    rng = np.random.default_rng(3)
    rows, seeds, want = [], [], {}
    for i in range(6):
        field = rng.integers(0, 4 if i % 2 else 9, (14, 17))
        own = {(int(y), int(x)): k for k, (y, x) in enumerate(np.argwhere(field > 0)[rng.permutation(60)[:5]], 1)}
        if i == 5:  # a corridor: one long way
            field, own = np.ones((1, 300), int), {(0, 0): 1, (0, 299): 2}
        rows += [(str(i), int(y), int(x), float(field[y, x])) for y, x in np.argwhere(field > 0)]
        seeds += [(str(i), y, x, k) for (y, x), k in own.items()]
        want |= {(str(i), *p): k for p, k in kruskal(field, own).items()}
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, distance double")
    markers = spark.createDataFrame(seeds, "image_id string, y int, x int, marker int")
    got = {(r.image_id, r.y, r.x): r.marker for r in watershed.flood_forest(pixels, markers).collect()}
    assert got == want
    assert watershed.flood_forest(pixels.limit(0), markers.limit(0)).count() == 0


def test_flood_forest_keeps_the_deepest_level(spark):
    """Each pixel is reached as deeply as by the search over all paths."""
    rng = np.random.default_rng(5)
    field = rng.integers(1, 6, (12, 12)).astype(float)
    own = {(0, 0): 1, (11, 11): 2, (0, 11): 3}
    pixels = spark.createDataFrame([("a", y, x, float(field[y, x])) for y in range(12) for x in range(12)], "image_id string, y int, x int, distance double")
    markers = spark.createDataFrame([("a", y, x, k) for (y, x), k in own.items()], "image_id string, y int, x int, marker int")
    forest = {(r.y, r.x): r.marker for r in watershed.flood_forest(pixels, markers).collect()}

    def reach(seeds, inside):
        best = {p: field[p] for p in seeds}
        while True:
            more = dict(best)
            for (y, x), level in best.items():
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if inside(q) and min(level, field[q]) > more.get(q, 0):
                        more[q] = min(level, field[q])
            if more == best:
                return best
            best = more

    everywhere = reach(own, lambda q: 0 <= q[0] < 12 and 0 <= q[1] < 12)
    for k in (1, 2, 3):
        own_part = reach([p for p, m in own.items() if m == k], lambda q: forest.get(q) == k)
        assert all(own_part[p] == everywhere[p] for p, m in forest.items() if m == k)


def test_report_labels_each_mask_once(make_masks, monkeypatch):
    mask = np.zeros((6, 6), bool)
    mask[0, :2] = mask[4, 3:] = True
    df = make_masks({"a": mask, "b": np.zeros((6, 6), bool)})
    planes = df.select("image_id", "height", "width", F.lit("float64").alias("dtype"), F.transform("mask", lambda m: m.cast("double")).alias("pixels"))
    monkeypatch.setattr(compare, "count_objects", None)  # counts come from the objects that were measured
    got = {r.image_id: r for r in compare.validation_report(planes, df, df).collect()}
    assert [got[k].mask_comparison.object_count_a for k in "ab"] == [2, 0]
    assert got["a"].measurement_comparison.mean_area_b == 2.5
