import hashlib
import random

import numpy as np
import pytest

from pixelframe.llm import centroid_clusters as cc

SCHEMA = "vec_id bigint, embedding array<double>"


def brute_force(rows, dimensions, scale, clusters, rounds):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [q for _, q in sorted(kept, key=seed)[:clusters]]

    def assign():
        out = []
        for i, q in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
            out.append((i, q, apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [q for _, q, k, _ in found if k == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = {c: sum(d for _, _, k, d in found if k == c) for c in range(len(centroids))}
    rows = sorted(((i, k, d, inertia[k], sum(inertia.values())) for i, _, k, d in found), key=str)
    return rows, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def check(spark, rows, **options):
    given = {"dimensions": 4, "scale": 64, "clusters": 5, "rounds": 3} | options
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", EMBEDDING int").repartition(3)
    found, centroids = cc.cluster(df, **given)
    want = brute_force(rows, **given)
    assert (sorted((tuple(r) for r in found.collect()), key=str), cc.digests(centroids)) == want


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(700)]
    rows += [(1000 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(400)] + rows[:7]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0] * 5), (2004, [None, 1.0, 1.0, 1.0])]
    rows += [(2005, [float("nan")] * 4), (2006, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4), (None, [-0.0] * 4)]
    rows += [(3000, [1e5, -1e5, 2e4, 0.0]), (3001, [1e5, -1e5, 2e4, 3.0])]
    check(spark, rows)
    check(spark, rows, rounds=0, clusters=1)


def test_ties_and_few_vectors(spark):
    check(spark, [(i, [float(i % 2)] * 4) for i in range(9)], clusters=4)
    check(spark, [(1, [0.5] * 4)], clusters=16)


def test_empty_table(spark):
    for rows in ([], [(1, None)]):
        found, centroids = cc.cluster(spark.createDataFrame(rows, SCHEMA), dimensions=4)
        assert found.collect() == [] and len(centroids) == 0
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        cc.cluster(spark.createDataFrame([(1, [1e30] * 4)], SCHEMA), dimensions=4)


def test_wide_ranges_take_the_same_table(spark):
    rng = np.random.default_rng(1)
    q = rng.integers(-10**6, 10**6, (300, 3))
    c = rng.integers(-10**6, 10**6, (4, 3))
    assert (cc.distances(q, c) == ((q[:, None, :] - c[None]) ** 2).sum(axis=2)).all()
