"""Clustering of vectors around centroids, in whole numbers, by scalar lookup tables.

Vectors are quantised to integers once. In every round a task tabulates, for each dimension, the squared difference
of every integer that occurs there to every centroid's component; the distance of a vector is then the sum of the
table rows its components point to, gathered with NumPy. All arithmetic is exact in 64 bits, so results do not depend on
how rows are dealt over tasks.

Only sums leave a task: one row per cluster and task, added up by Spark, and one row per cluster reaches the driver.
Nothing but the centroids is sent back, so hot or repeated vectors are ordinary rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import discard, durable
from pixelframe.llm.columns import take
from pixelframe.llm.workers import prepare

#: Integers must be nearer to zero than this, so that no squared distance of 64 components leaves 64 bits.
LIMIT = 1 << 27

#: Rows that are worked on together inside a task.
ROWS = 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``id, q``: the vectors with exactly ``dimensions`` components, none null or non-finite, as integers
    ``floor(scale * x)`` (``x`` as double). An integer outside of +-``LIMIT`` is an error rather than a wrong distance."""
    own = take(vectors, id=id_col, v=vector_col)
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = own.where(F.coalesce((F.size("v") == dimensions) & finite, F.lit(False)))
    scaled = F.transform("v", lambda x: F.lit(float(scale)) * x.cast("double"))
    far = F.exists(scaled, lambda y: F.abs(y) >= LIMIT)
    checked = F.when(far, F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}"))).otherwise(
        F.transform(scaled, lambda y: F.floor(y).cast("int"))
    )
    return kept.select("id", checked.alias("q"))


def first_centroids(rows: DataFrame, clusters: int, seed: Column) -> np.ndarray:
    """The ``clusters`` vectors with the smallest ``seed`` (nulls last, equal ones by their components), in that order."""
    chosen = rows.select(seed.alias("s"), "q").orderBy(F.col("s").asc_nulls_last(), "q").limit(clusters).collect()
    return np.array([r.q for r in chosen], dtype=np.int64)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``q`` to all centroids."""
    total = np.zeros((len(q), len(centroids)), dtype=np.int64)
    for d in range(q.shape[1]):
        values, codes = _occurring(q[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[codes]
    return total


def _occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a column, ascending, and where each row's stands among them."""
    low, high = int(column.min()), int(column.max())
    if high - low > 4 * ROWS:
        return np.unique(column, return_inverse=True)
    there = np.zeros(high - low + 1, dtype=bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(part.schema.get_field_index("q")).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.astype(np.int64).reshape(-1, dimensions)


def _updated(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, then floor(sum / count) per component; empty clusters keep their centroid."""
    clusters, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for _, q in _batches(batches, dimensions):
            nearest = distances(q, centroids).argmin(axis=1)
            order = np.argsort(nearest, kind="stable")
            present, starts = np.unique(nearest[order], return_index=True)
            totals[present] += np.add.reduceat(q[order], starts, axis=0)
            counts += np.bincount(nearest, minlength=clusters)
        columns = [pa.array(np.arange(clusters, dtype=np.int32)), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array(totals[:, d]) for d in range(dimensions)], ["cluster", "n", *[f"s{d}" for d in range(dimensions)]]
        )

    wide = ", ".join(f"s{d} bigint" for d in range(dimensions))
    partial = rows.select("q").mapInArrow(sums, f"cluster int, n bigint, {wide}")
    exact = [F.sum(F.col(f"s{d}").cast("decimal(38,0)")).alias(f"s{d}") for d in range(dimensions)]
    after = centroids.copy()
    for r in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        if r.n:
            after[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dimensions)]
    return after


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = 64,
    scale: int = 64,
    clusters: int = 16,
    rounds: int = 3,
    seed: str = "1:",
) -> tuple[DataFrame, np.ndarray]:
    """``<id_col>, cluster, distance, cluster_inertia, inertia`` per kept vector, and the final centroids.

    Kept are vectors as :func:`quantised` says; all others have no row. The first centroids are the ``clusters`` kept
    vectors with the smallest sha256 of ``seed`` and id (a null id comes last); fewer vectors give fewer clusters.
    Each round assigns every vector to the nearest centroid (ties: the smaller number) and moves every non-empty
    centroid to the floor of its mean; at the end vectors are assigned once more. Repeated rows and ids all count and
    all come back, further columns are ignored whatever their names, an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = durable(quantised(vectors, id_col, vector_col, dimensions, scale))
    centroids = first_centroids(rows, clusters, F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256))
    if not len(centroids):
        none = rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        zero = F.lit(0).cast("bigint")
        return none.select("*", zero.alias("cluster_inertia"), zero.alias("inertia")), centroids
    for _ in range(rounds):
        centroids = _updated(rows, centroids)
    final = centroids

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, q in _batches(batches, dimensions):
            apart = distances(q, final)
            nearest = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("id")), pa.array(nearest.astype(np.int32)), pa.array(apart.min(axis=1))],
                ["id", "cluster", "distance"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    found = durable(rows.mapInArrow(assigned, f"id {kind}, cluster int, distance bigint"))
    discard(rows)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    per_cluster = F.array(*[F.lit(sums.get(c, 0)).cast("bigint") for c in range(len(final))])
    out = found.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.element_at(per_cluster, F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
    )
    return out, final


def digests(centroids: np.ndarray) -> list[str]:
    """Digest of each centroid's components as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
