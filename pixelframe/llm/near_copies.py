"""Near copies by the Jaccard similarity of word shingles, proposed by fingerprints and compared exactly.

SimHash fingerprints (:mod:`.simhash`, as op3 links them) propose pairs; the exact similarity decides on each. Fingerprints
of few differing bits miss most pairs near the limit, so a second search, exact as well, adds those.

MinHash bands tell which texts can have a near copy at all: a pair of similarity ``s`` shares one of the 16 bands of four
minima with probability ``1 - (1 - s**4)**16``, 0.9998 at 0.8. The pairs among those texts come from a prefix-filtered
join that loses none. Shingles are ordered by the number of texts that hold them, rarest first. Two similar texts
share a shingle among the first fifth of both (and the smaller set among its first ninth), at places that leave room for
the overlap they need; so shingles that everybody has hardly ever propose a pair, and texts of which too many
shingles stand in no other text drop out before.

Of a shingle that proposes many pairs, all texts first meet the plainest one, which has the fewest rarer shingles: of edited
copies that is the original, or the one nearest to it. Texts that are then known to be of one group need not meet again:
per shingle, only texts outside its largest group meet all the others. So large groups of copies cost pairs in
proportion to their texts, and still every pair that could join two groups is compared.

Texts with the same words are one node from the start. Texts without words are equal. Letters of scripts written without
spaces count as a word each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm import simhash
from pixelframe.llm.columns import packed, unpacked
from pixelframe.llm.components import components
from pixelframe.llm.sentence_spans import _UNSPACED
from pixelframe.llm.workers import prepare, text_expression

BANDS, ROWS = 16, 4
_LETTER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _UNSPACED) + "]")
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, cut at ASCII white space and round every letter of an unspaced script."""
    if not text.isascii():
        text = _LETTER.sub(r" \g<0> ", text)
    return text.encode("utf-8").lower().split()


def shingles(text: str, words: int) -> np.ndarray:
    """The set of XXH64 of all runs of ``words`` words, sorted; a shorter text is one run, one without words none."""
    own = words_of(text)
    if not own:
        return np.zeros(0, np.uint64)
    found = [xxhash.xxh64_intdigest(b" ".join(own[i : i + words])) for i in range(max(1, len(own) - words + 1))]
    return np.unique(np.array(found, np.uint64))


def band_values(found: np.ndarray) -> np.ndarray:
    """One value for each band, of the minima of its ``ROWS`` hash functions."""
    if not len(found):
        return np.zeros(BANDS, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(found), 4096):
        x = found[i : i + 4096, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * _MIX).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _signature(words: int):
    """``struct<node, size, bands>`` of a text column."""

    def of(text: pa.Array) -> pa.Array:
        texts = _texts(text)
        nodes = np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t))) for t in texts], np.uint64)
        sets = [shingles(t, words) for t in texts]
        bands = np.concatenate([np.zeros(0, np.uint64), *map(band_values, sets)])
        listed = pa.ListArray.from_arrays(
            pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64))
        )
        sizes = pa.array(np.array(list(map(len, sets)), np.int32))
        return pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), sizes, listed], ["node", "size", "bands"])

    return text_expression(of, "struct<node: bigint, size: int, bands: array<bigint>>", 1 << 19)


def _shingle_sets(words: int):
    def of(text: pa.Array) -> pa.Array:
        return pa.array([shingles(t, words).view(np.int64) for t in _texts(text)], pa.list_(pa.int64()))

    return text_expression(of, "array<bigint>", 1 << 19)


def alive(nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` (``node, bands``, distinct) that share a band with another one."""
    placed = durable(nodes.select("node", F.explode("bands").alias("bucket")))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return placed.join(durable(shared), "bucket").select("node").distinct()


def ordered_sets(tokens: DataFrame, similarity: float) -> DataFrame:
    """``node, size, own``: the shingles that a node of ``tokens`` (``node, size, h``, distinct) shares with others, rarest
    first, for the nodes that share enough of them to have a partner."""
    often = durable(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    listed = F.sort_array(F.collect_list(F.struct("n", "h")))
    sets = tokens.join(often, "h").groupBy("node").agg(F.first("size").alias("size"), listed.alias("own"))
    sets = sets.where(F.size("own") >= _needed(similarity))
    return durable(sets.select("node", "size", F.transform("own", lambda x: x["h"]).alias("own")))


def _needed(similarity: float) -> Column:
    """The least overlap of a set of ``size`` with any similar one."""
    return F.ceil(F.col("size") * similarity - 1e-6)


def _entries(sets: DataFrame, similarity: float) -> DataFrame:
    """``h, node, size, left, small``: the prefix of every set; ``left`` counts the shingles from there to its end, ``small``
    tells whether the set can be the smaller one of a pair that meets here first."""
    alone = F.col("size") - F.size("own")  # shingles of no other text come before all others
    prefix = F.slice("own", F.lit(1), (F.col("size") - _needed(similarity) + 1 - alone).cast("int"))
    each = sets.select("node", "size", alone.alias("alone"), F.posexplode(prefix).alias("at", "h"))
    left = F.col("size") - F.col("alone") - F.col("at")
    least = F.col("size") * (2 * similarity / (1 + similarity)) - 1e-6
    return each.select("h", "node", "size", left.alias("left"), (left >= least).alias("small"))


def _fits(x: str, y: str, similarity: float) -> Column:
    """Whether entry ``x`` can be the smaller set, and ``y`` the larger one, of a pair that meets here first."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    order = (a("size") < b("size")) | ((a("size") == b("size")) & (a("node") < b("node")))
    room = F.least(a("left"), b("left")) >= (a("size") + b("size")) * (similarity / (1 + similarity)) - 1e-6
    return a("small") & order & (a("size") >= b("size") * similarity - 1e-6) & room


def _pairs(x: DataFrame, y: DataFrame, similarity: float, further: Column | None = None) -> DataFrame:
    x, y = x.alias("x"), y.alias("y")
    on = (F.col("x.h") == F.col("y.h")) & _fits("x", "y", similarity)
    joined = x.join(y, on if further is None else on & further)
    return joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: the pairs (``a, b``) whose sets are similar; shingles of no other text only count as sizes."""
    pairs = durable(pairs.distinct())
    own = sets.select(F.col("node").alias("a"), F.col("own").alias("x"), F.col("size").alias("p"))
    other = sets.select(F.col("node").alias("b"), F.col("own").alias("y"), F.col("size").alias("q"))
    met = durable(pairs.join(own, "a")).join(other, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    enough = F.col("both") >= F.lit(similarity) * (F.col("p") + F.col("q") - F.col("both")) - 1e-6
    return durable(met.where(enough).select(F.col("a").alias("src"), F.col("b").alias("dst")))


def set_links(sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: links between ``sets`` (see :func:`ordered_sets`) that connect whatever similar pairs connect."""
    entries = durable(_entries(sets, similarity))
    plain = F.struct((F.col("size") - F.col("left")).alias("rarer"), "size", "node", "left", "small")
    first = durable(entries.groupBy("h").agg(F.min(plain).alias("f")).select("h", "f.size", "f.node", "f.left", "f.small"))
    met = _pairs(first, entries, similarity).unionByName(_pairs(entries, first, similarity))
    found = _similar(met, sets, similarity)
    grouped = entries.join(components(found), "node", "left")
    grouped = durable(grouped.select("h", "node", "size", "left", "small", F.coalesce("root", "node").alias("root")))
    parts = grouped.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("h").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("groups"))
    largest = durable(largest.where("groups > 1").select("h", F.col("m.root").alias("main")))
    all_of = durable(grouped.join(largest, "h"))
    rest = durable(all_of.where("root != main"))
    apart = F.col("x.root") != F.col("y.root")
    pairs = _pairs(rest, all_of, similarity, apart).unionByName(_pairs(all_of, rest, similarity, apart))
    return found.unionByName(_similar(pairs, sets, similarity))


def proposed(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``nodes`` (``node, fp``) with linked fingerprints; all nodes of a fingerprint meet its smallest one."""
    least = durable(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    linked = simhash.links(least)
    for end, name in (("src", "a"), ("dst", "b")):
        linked = linked.join(least.select(F.col("fp").alias(end), F.col("least").alias(name)), end)
    equal = nodes.join(least, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return durable(linked.select("a", "b").unionByName(equal))


def links(found: DataFrame, words: int, similarity: float) -> DataFrame:
    """``src, dst``: links between nodes of ``found`` (``node, size, bands, fp, row, text``) of at least ``similarity``."""
    nodes = found.groupBy("node").agg(F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.min("row").alias("row"))
    nodes = durable(nodes)
    pairs = proposed(nodes.select("node", "fp"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    wanted = alive(nodes).unionByName(ends).distinct().join(nodes.select("node", "row"), "node").select("row")
    texts = found.select("row", "node", "size", "text").join(durable(wanted), "row")
    tokens = durable(texts.select("node", "size", F.explode(_shingle_sets(words)(F.col("text"))).alias("h")))
    sets = ordered_sets(tokens, similarity)
    return set_links(sets, similarity).unionByName(_similar(pairs, sets, similarity))


def keep_one(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of near copies.

    Groups are closed over pairs of at least ``similarity``. The row with the smallest id stays, of rows with
    the same id any one of them; null ids come last. Null, empty and blank texts are one group. Texts shorter than a
    shingle are near copies only of texts with the same words. Texts of any length are compared whole, repeated rows are
    one group, other columns are passed on whatever they are called, and an empty table stays empty.
    """
    prepare(docs.sparkSession)
    found = packed(docs, doc_id=id_col, text=text_col).select(
        "doc",
        "doc_id",
        "text",
        _signature(words)(F.col("text")).alias("s"),
        simhash.fingerprint()(F.col("text")).alias("fp"),
        F.monotonically_increasing_id().alias("row"),
    )
    place = docs.columns.index(text_col)
    found = durable(found.select("doc", "doc_id", "row", "fp", "s.*"))
    roots = components(links(found.withColumn("text", F.col(f"doc._{place}")), words, similarity))
    placed = found.select("node", "doc_id", "row").join(roots, "node", "left")
    at = F.struct(F.isnull("doc_id"), "doc_id", "row").alias("at")
    placed = placed.select(F.coalesce("root", "node").alias("root"), at)
    best = placed.groupBy("root").agg(F.min("at").alias("best"))
    others = placed.join(best, "root").where("at.row != best.row").select("at.row")
    return unpacked(found.join(others, "row", "left_anti"), docs.columns)
