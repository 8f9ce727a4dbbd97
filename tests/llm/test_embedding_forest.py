import math

import numpy as np
from pyspark.sql import functions as F

from pixelframe.llm.embedding_forest import near_duplicates

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, least=0.93):
    """``{position: (links, component)}`` over all pairs with equal labels."""

    def sound(v):
        return v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    near = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and sound(v) and sound(w) and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    near[i].add(j), near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out[i] = (len(near[i]), min(ids, default=None))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("component_id"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df, **more).collect()), key=str)
    want = [(rows[i][0], n, c, c == rows[i][0]) for i, (n, c) in brute_force(rows).items()]
    return got, sorted(want, key=str)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1)]
    rows += [(7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (None, [2.0, 0.1], 2)]
    rows += [(10, [1.0, 0.0, 0.0], 2), (11, [-1.0, 0.0], 2), (12, [1.0, 0.0], 3)]
    got, want = check(spark, rows)
    assert got == want
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame(rows[:3], SCHEMA)).count() == 3


def test_one_deep_forest_with_blocks_and_a_hot_group(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    vectors = [centre + 0.1 * rng.standard_normal(32) for _ in range(150)]
    vectors += [v + 0.06 * rng.standard_normal(32) for v in rng.standard_normal((60, 32)) for _ in range(2)]
    rows = [(i, [float(x) for x in v], 0 if i < 150 else i % 2) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(80)]
    got, want = check(spark, rows, leaf_rows=24, block_rows=16, sample_rows=200)
    found, total = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.9 * total <= found <= total
    assert sum(a[2] == b[2] for a, b in zip(got, want)) >= 0.97 * len(want)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        v, noise = rng.standard_normal(64), rng.standard_normal(64)
        v, noise = v / np.linalg.norm(v), noise - v * (noise @ v) / (v @ v)
        w = 0.935 * v + math.sqrt(1 - 0.935**2) * noise / np.linalg.norm(noise)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, w.tolist(), 0)]
    got, want = check(spark, rows, leaf_rows=64)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
