"""SimHash near-dedup: fingerprints, links between fingerprints, and their components.

Links are found in a segment-popcount embedding. A fingerprint maps to the number of set bits in each of its
32 two-bit segments; the Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. The vectors are laid on a grid: their coordinates form ``blocks`` blocks, and two vectors within
distance ``d`` agree in all but ``d`` blocks, so they share a cell in at least one projection on
``blocks - d`` blocks. An equi-join on (projection, cell) tests the Manhattan distance in full and then the
fingerprints themselves, so no link is lost. (One coarse grid over the whole space would propose a constant
part of all pairs, because bit counts gather round their mean; projections keep cells small.)

Equal fingerprints are one node from the start, so exact copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import packed, take, unpacked
from pixelframe.llm.components import components
from pixelframe.llm.workers import prepare, text_expression


def fingerprint_many(texts: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """Majority bits of the XXH64 of all word shingles of each text, as unsigned integers; no word, zero."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        own = text.lower().split()
        if not own:
            continue
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        n = max(1, len(own) - words + 1)
        starts = np.append(0, ends[:-1] + 1)[:n].tolist()
        lasts = ends[min(words, len(own)) - 1 :].tolist()
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, lasts)]
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        majority = np.packbits(ones * 2 > counts[some][:, None], axis=1, bitorder="little")
        out[some] = majority.view("<u8").ravel()
    return out


def fingerprint(words: int = 4) -> Callable[[Column], Column]:
    """An expression for the fingerprint of a text column, as a signed 64-bit integer; null counts as empty."""

    def of(text: pa.Array) -> pa.Array:
        found = fingerprint_many([t or b"" for t in text.cast(pa.binary()).to_pylist()], words)
        return pa.array(found.view(np.int64))

    return text_expression(of, "bigint", 1 << 19)


_LOW = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary (0, 01, 11): the Manhattan distance of two such
    vectors is the number of bits in which their unary forms differ."""
    low, half = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(half).bitwiseAND(low)
    both = fp.bitwiseAND(half).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of whole segments, as signed 64-bit values."""
    edges = [2 * (32 * b // blocks) for b in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) - ((1 << 64) if hi == 64 else 0) for lo, hi in zip(edges, edges[1:])]


def links(nodes: DataFrame, distance: int = 4, blocks: int = 6) -> DataFrame:
    """``src, dst``: all pairs of distinct ``fp`` of ``nodes`` that differ in at most ``distance`` bits.

    ``blocks`` trades cells (``C(blocks, distance)`` per fingerprint) for their size; every value above
    ``distance`` gives the same pairs.
    """
    if not 0 < distance < blocks <= 32:
        raise ValueError("blocks must lie above the distance and not above 32")
    masks = _block_masks(blocks)
    kept = list(combinations(range(blocks), blocks - distance))
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("projection"),
                    F.col("counts").bitwiseAND(F.lit(sum(masks[b] for b in own))).alias("cell"),
                )
                for k, own in enumerate(kept)
            ]
        )
    )
    placed = nodes.select("fp", segment_counts(F.col("fp")).alias("counts"))
    placed = placed.select("fp", "counts", cells.alias("c")).select("fp", "counts", "c.*")
    a, b = placed.alias("a"), placed.alias("b")
    apart = F.col("a.counts").bitwiseXOR(F.col("b.counts"))

    def first_shared(own: tuple[int, ...]) -> Column:
        """No block before the last of ``own`` agrees besides them, so each pair counts in one projection."""
        others = [apart.bitwiseAND(F.lit(masks[x])) != 0 for x in range(own[-1]) if x not in own]
        return reduce(Column.__and__, others, F.lit(True))

    once = F.lit(False)
    for k, own in enumerate(kept):
        once = F.when(F.col("a.projection") == k, first_shared(own)).otherwise(once)
    near = (F.bit_count(apart) <= distance) & (
        F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    )
    same_cell = (F.col("a.projection") == F.col("b.projection")) & (F.col("a.cell") == F.col("b.cell"))
    return a.join(b, same_cell & (F.col("a.fp") < F.col("b.fp")) & near & once).select(
        F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    blocks: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per input row.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links of at
    most ``distance`` differing bits, the own one included. Null and wordless texts share fingerprint zero.
    Repeated rows each get a row; null ids are never the smallest unless a component has no other.
    """
    prepare(docs.sparkSession)
    chosen = take(docs, doc_id=id_col, text=text_col)
    found = durable(chosen.select("doc_id", fingerprint(words)(F.col("text")).alias("fp")))
    named = _named(found, distance, blocks)
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    blocks: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component.

    The row with the smallest id stays, of rows with the same id any one of them; null ids come last.
    """
    prepare(docs.sparkSession)
    found = durable(
        packed(docs, doc_id=id_col, text=text_col).select(
            "doc",
            "doc_id",
            fingerprint(words)(F.col("text")).alias("fp"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    roots = components(links(found.select("fp").distinct(), distance, blocks))
    placed = found.select("fp", "doc_id", "row").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select(F.coalesce("root", "fp").alias("root"), F.struct(F.isnull("doc_id"), "doc_id", "row").alias("at"))
    best = placed.groupBy("root").agg(F.min("at").alias("best"))
    others = placed.join(best, "root").where("at.row != best.row").select("at.row")
    return unpacked(found.join(others, "row", "left_anti"), docs.columns)


def _named(found: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fp, component_id`` for every fingerprint of ``found`` (``doc_id, fp``)."""
    nodes = durable(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, distance, blocks))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    shared = grouped.join(roots.select("root").distinct(), "root", "left_semi")
    least = shared.groupBy("root").agg(F.min("least").alias("component"))
    return grouped.join(least, "root", "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )
