"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits space recursively: a node projects on a random direction and cuts near the median, in the widest
gap of its middle part, and vectors close to the cut go to both sides (spill). Vectors that share a leaf of any
tree and a label are compared by cosine, in double precision. The trees are fitted on a bounded sample; every
vector is routed through all of them.

Equal vectors are one node from the start. A leaf reports, for each vector, how many links it adds, and links
that span the components inside the leaf, never its pairs: a pair counts in the first leaf that both vectors share,
which their lists of leaves tell. Large leaves are cut into blocks, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import take
from pixelframe.llm.components import components
from pixelframe.llm.workers import map_slices, prepare

_LEAF_BITS = 24


@dataclass
class Node:
    direction: np.ndarray
    low: float  # vectors at or above go right
    high: float  # vectors below go left
    left: Node | None
    right: Node | None


@dataclass
class Forest:
    """Trees and the number of dimensions; shorter vectors count as padded with zeros."""

    trees: list[Node | None]
    dims: int

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves, leaf numbers unique over all trees; a row has one leaf of each tree or more."""
        rows, leaves = [], []
        for t, tree in enumerate(self.trees):
            stack = [(tree, 1, np.arange(len(vectors)))]
            while stack:
                node, place, own = stack.pop()
                if not len(own):
                    continue
                if node is None:
                    rows.append(own)
                    leaves.append(np.full(len(own), (t << _LEAF_BITS) + place, np.int32))
                    continue
                at = vectors[own] @ node.direction
                stack.append((node.left, 2 * place, own[at < node.high]))
                stack.append((node.right, 2 * place + 1, own[at >= node.low]))
        return np.concatenate(rows), np.concatenate(leaves)


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator, spill: float, least: int = 8) -> Node | None:
    """A tree of ``depth`` levels at most; nodes with fewer than ``2 * least`` vectors of the sample are leaves.

    ``spill`` is the part of a node's vectors that goes to both sides.
    """
    if depth == 0 or len(sample) < 2 * least:
        return None
    direction = rng.standard_normal(sample.shape[1]).astype(np.float32)
    direction /= np.linalg.norm(direction)
    at = np.sort(sample @ direction)
    first, last = int(0.3 * len(at)), int(0.7 * len(at))
    k = first + int(np.argmax(np.diff(at[first : last + 1])))
    cut, beside = (at[k] + at[k + 1]) / 2, int(spill * len(at) / 2)
    low, high = min(cut, at[max(0, k - beside)]), max(cut, at[min(len(at) - 1, k + 1 + beside)])
    if not at[0] < cut <= at[-1]:  # all the same: no direction will part them
        return None
    here = sample @ direction
    left = grow(sample[here < high], depth - 1, rng, spill, least)
    right = grow(sample[here >= low], depth - 1, rng, spill, least)
    return Node(direction, float(low), float(high), left, right)


def matrix(column: pa.Array, dims: int, kind=np.float32) -> np.ndarray:
    """Unit vectors of a column of lists, padded to ``dims``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(kind)


def fit(nodes: DataFrame, trees: int, leaf_rows: int, spill: float, sample_rows: int, seed: int) -> Forest | None:
    """A forest for the vectors of ``nodes`` (``id, label, dims, vec``); None if there are none.

    It is grown on about ``sample_rows`` vectors (those with the smallest hashes), so deep that the largest
    label has about ``leaf_rows`` vectors in a leaf, as far as the sample can tell.
    """
    found = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("most"), F.sum("n").alias("all"), F.max("dims").alias("dims")
    ).first()
    if not found["all"]:
        return None
    chance = min(1.0, sample_rows / found["all"])
    kept = nodes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30)))
    rows = kept.select("vec").limit(2 * sample_rows).toArrow().column("vec").combine_chunks()
    sample = matrix(rows, found["dims"]) if len(rows) else np.zeros((0, found["dims"]), np.float32)
    depth = min(20, max(0, int(np.ceil(np.log2(found["most"] / leaf_rows)))))
    rng = np.random.default_rng(seed)
    return Forest([grow(sample, depth, rng, spill) for _ in range(trees)], found["dims"])


def _route(nodes: DataFrame, forest: Forest) -> DataFrame:
    """``id, label, dims, copies, vec, leaves``: ascending leaves of every vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, leaves = forest.leaves(matrix(batch.column(4), forest.dims))
        order = np.lexsort((leaves, rows))
        bounds = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaves[order]))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])

    chosen = nodes.select("id", "label", "dims", "copies", "vec")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return map_slices(chosen, run, f"{kinds}, leaves array<int>")


def compare(own: pd.DataFrame, leaf: int, blocks: tuple[int, int], least_cosine: float) -> pd.DataFrame:
    """Links inside one block of a leaf, or between two: ``src`` with ``links`` added to it, or with ``dst``."""
    own = own.sort_values("id")
    x = np.array(own["vec"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, copies = own["id"].to_numpy(), own["copies"].to_numpy()
    near = x @ x.T >= least_cosine
    np.fill_diagonal(near, False)
    if blocks[0] != blocks[1]:
        side = own["block"].to_numpy()
        near &= side[:, None] != side[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return pd.DataFrame({"src": [], "dst": [], "links": []}).astype({"src": "int64", "dst": "Int64", "links": "int64"})
    near, ids, copies = near[np.ix_(some, some)], ids[some], copies[some]
    before = [[k for k in row if k < leaf] for row in own["leaves"].iloc[some]]
    names = {k: i for i, k in enumerate(sorted({k for row in before for k in row}))}
    met = np.zeros((len(some), max(1, len(names))), np.float32)
    for i, row in enumerate(before):
        met[i, [names[k] for k in row]] = 1
    fresh = near & (met @ met.T == 0)
    root = np.arange(len(some))
    while True:  # the smallest id of every component, by its links
        least = np.minimum(root, np.where(near, root[None, :], len(root)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(len(some)))
    added = fresh @ copies
    counted = np.flatnonzero(added)
    return pd.DataFrame(
        {
            "src": np.concatenate([ids[counted], ids[moved]]),
            "dst": pd.array([None] * len(counted) + ids[root[moved]].tolist(), "Int64"),
            "links": np.concatenate([added[counted], np.zeros(len(moved), np.int64)]),
        }
    )


def near_duplicates(
    vectors: DataFrame,
    least_cosine: float = 0.93,
    trees: int = 10,
    leaf_rows: int = 512,
    spill: float = 0.1,
    block_rows: int = 1024,
    sample_rows: int = 20_000,
    seed: int = 11,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    ``n_links`` counts the other vectors found with cosine ``least_cosine`` or more, ``component_id`` is the
    smallest id reachable over links, and ``kept`` tells whether that is the own one. Vectors without a label, null,
    zero, or with null or non-finite components link with nothing; neither do vectors of different lengths. Equal
    vectors of one label always link. An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = take(vectors, vec_id=id_col, vec=vec_col, label=label_col)
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    inf = F.lit(float("inf"))
    sound = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)) & F.exists("vec", lambda v: v != 0)
    good = F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    rows = rows.withColumn("good", good).withColumns(
        {"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit(1), "vec", "label")}
    )
    nodes = durable(
        rows.where("good")
        .groupBy("k1", "k2")
        .agg(
            F.first("label").alias("label"),
            F.first("vec").alias("vec"),
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("least"),
        )
        .select("*", F.size("vec").alias("dims"), F.monotonically_increasing_id().alias("id"))
    )
    forest = fit(nodes, trees, leaf_rows, spill, sample_rows, seed)
    links = components_of = None
    if forest is not None:
        links = durable(_links(nodes, forest, block_rows, least_cosine))
        counts = links.where("dst IS NULL").groupBy(F.col("src").alias("id")).agg(F.sum("links").alias("links"))
        roots = components(links.where("dst IS NOT NULL").select("src", "dst"))
        named = nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        smallest = named.groupBy("root").agg(F.min("least").alias("component"))
        components_of = (
            named.join(smallest, "root").join(counts, "id", "left")
            .select("k1", "k2", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
        )
        found = rows.select("vec_id", "good", "k1", "k2").join(components_of.withColumn("good", F.lit(True)), ["good", "k1", "k2"], "left")
    else:
        found = rows.select("vec_id", F.lit(None).cast("bigint").alias("n"), F.col("vec_id").alias("component"))
    component = F.coalesce("component", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _links(nodes: DataFrame, forest: Forest, block_rows: int, least_cosine: float) -> DataFrame:
    """``src, dst, links`` of all leaves, block pair by block pair."""
    placed = _route(nodes, forest).withColumn("leaf", F.explode("leaves"))
    key = ["label", "dims", "leaf"]
    blocks = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    cut = placed.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    with_other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key,
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        "block", "id", "copies", "vec", "leaves",
    )

    def run(group: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return compare(own, group[2], (group[3], group[4]), least_cosine)

    return with_other.groupBy(*key, "a", "b").applyInPandas(run, "src bigint, dst bigint, links bigint")
