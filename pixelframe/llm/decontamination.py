"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``window`` consecutive item words is a set of word shingles. A document can only contain a window
if it contains the window's rarest shingle, so that one shingle is the whole necessary prefix for full
containment. Steps:

1. count in all documents the shingles that the benchmark has (rarity order);
2. take each window's rarest shingle as its prefix;
3. list the places where documents have a prefix shingle, with the words around them;
4. join places and windows on the shingle, keep those where the window lies inside the document (positional
   and length bounds), and compare the words themselves.

Documents are filtered before the shuffle by a bit table of fixed size, so nothing broadcast grows with either
side; the join decides. Common shingles are hardly ever prefixes, so they are counted and never joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import packed, row_key, take, unpacked
from pixelframe.llm.wordhash import words
from pixelframe.llm.workers import map_slices

_SHINGLE = 3
_BITS = 24  # places in the bit table: 2 MB, whatever the size of the tables


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64), (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def bit_table(shingles: DataFrame) -> np.ndarray:
    """Bits of both places of every ``h``; at most ``2 ** 19`` words of 32 bits come to the driver."""
    both = F.array(F.shiftrightunsigned("h", 64 - _BITS), F.col("h").bitwiseAND(F.lit((1 << _BITS) - 1)))
    found = (
        shingles.select(F.explode(both).alias("place"))
        .groupBy(F.shiftright("place", 5).alias("entry"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (_BITS - 5), "<u4")
    for entry, bits in found:
        table[entry] = bits
    return table.view(np.uint8)


def known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _places(h)
    return (table[one >> 3] >> (one & 7) & table[two >> 3] >> (two & 7) & 1).astype(bool)


def item_windows(items: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, words string, n, shingles array<bigint>``: every window of every item; no words, no window."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1))
        row, out = found.row(), []
        hashes = {size: found.shingles(size, row)[0].view(np.int64) for size in range(1, _SHINGLE + 1)}
        placed = {size: found.shingles(size, row)[1] for size in hashes}
        for i, item in enumerate(batch.column(0).to_pylist()):
            a, b = int(found.firsts[i]), int(found.firsts[i + 1])
            own, n = found.text(a, b), min(window, b - a)
            size = min(_SHINGLE, n)
            for at in range(a, b - n + 1) if n else ():
                k = np.searchsorted(placed[size], at)
                out.append((item, " ".join(own[at - a : at - a + n]), n, hashes[size][k : k + n - size + 1].tolist()))
        kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.list_(pa.int64()))
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["item", "words", "n", "shingles"]
        )

    chosen = take(items, item=item_col, text=text_col)
    kind = chosen.schema["item"].dataType.simpleString()
    return map_slices(chosen, run, f"item {kind}, words string, n int, shingles array<bigint>", "text")


def _count(texts: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """``h, times``: how often documents have each shingle of the bit table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(0))
        row = found.row()
        hashes = np.concatenate([found.shingles(size, row)[0] for size in sizes])
        h, times = np.unique(hashes[known(table, hashes)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], ["h", "times"])

    seen = map_slices(texts, run, "h bigint, times bigint", "text")
    return seen.groupBy("h").agg(F.sum("times").alias("times"))


def _places_in_documents(docs: DataFrame, table: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """``key, doc_id, n_words, places``: each document with its places of prefix shingles and the words around.

    ``key`` stands for the whole row, so repeated ids (also null ones) never mix.
    """
    reach = window - 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1))
        row, places = found.row(), [[] for _ in range(batch.num_rows)]
        for size in sizes:
            h, first = found.shingles(size, row)
            hit = known(table, h)
            for value, at in zip(h[hit].view(np.int64).tolist(), first[hit].tolist()):
                r = int(row[at])
                a, b = int(found.firsts[r]), int(found.firsts[r + 1])
                left = max(a, at - reach)
                places[r].append(
                    {"h": value, "at": at - a, "left": left - a, "around": found.text(left, min(b, at + window))}
                )
        place = pa.struct(
            [("h", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]
        )
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(np.diff(found.firsts), pa.int64()),
                pa.array(places, pa.list_(place)),
            ],
            ["key", "doc_id", "n_words", "places"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = "array<struct<h: bigint, at: int, left: int, around: array<string>>>"
    return map_slices(docs, run, f"key binary, doc_id {kind}, n_words bigint, places {place}", "text")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``key, doc_id, n_words, spans array<struct<start,end>>, n_hit, items array<string>``, a row per document row.

    ``key`` is the :func:`row_key` of id and text.
    ``spans`` are the word ranges covered by occurrences of item windows, merged and in order; ``items`` the
    sorted ids of the items concerned. A null or wordless text has no words and no hits; items without words
    match nothing; an empty benchmark leaves all documents clean. Repeated rows each get a row.
    """
    windows = durable(item_windows(items, window, item_col, item_text_col))
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(_SHINGLE)).alias("s")).distinct().collect())
    sizes = sizes or [_SHINGLE]
    unique = windows.groupBy("words", "n").agg(F.first("shingles").alias("shingles"))
    shingles = unique.select("words", "n", F.posexplode("shingles").alias("offset", "h"))
    texts = take(docs, doc_id=id_col, text=text_col).select(row_key("doc_id", "text").alias("key"), "text", "doc_id")
    times = _count(texts.select("text"), bit_table(shingles.select("h").distinct()), sizes)
    order = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "h")
    prefixes = durable(
        shingles.join(times, "h", "left")
        .groupBy("words", "n")
        .agg(F.min(order).alias("p"))
        .select("words", "n", "p.offset", "p.h")
    )
    listed = durable(
        _places_in_documents(texts, bit_table(prefixes.select("h").distinct()), sizes, window)
    )
    places = listed.select("key", "n_words", F.explode("places").alias("p")).select("key", "n_words", "p.*")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))  # positional and length bounds
    same = F.array_join(F.slice("around", start - F.col("left") + 1, F.col("n")), " ") == F.col("words")
    hits = durable(
        places.join(prefixes, "h")
        .where(inside & F.when(inside, same))
        .select("key", start.alias("start"), (start + F.col("n")).alias("end"), "words")
        .distinct()
    )
    own_items = (
        hits.select("key", "words")
        .distinct()
        .join(windows.select("words", F.col("item").cast("string").alias("item")).distinct(), "words")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    ranges = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    ).select("key", _merged("spans").alias("spans"))
    empty = "CAST(array() AS array<struct<start: int, end: int>>)"
    return (
        listed.select("key", "doc_id", "n_words")
        .join(ranges.join(own_items, "key"), "key", "left")
        .select(
            "key",
            "doc_id",
            "n_words",
            F.coalesce("spans", F.expr(empty)).alias("spans"),
            F.coalesce(F.expr("aggregate(spans, 0L, (t, x) -> t + x.end - x.start)"), F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        )
    )


def _merged(spans: str):
    """Sorted ranges with those that touch or overlap joined: a range starts where none before reaches."""
    return F.expr(
        f"""aggregate({spans}, CAST(array() AS array<struct<start: int, end: int>>), (done, x) ->
        IF(size(done) > 0 AND element_at(done, -1).end >= x.start,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                  'end', greatest(element_at(done, -1).end, x.end)))),
           concat(done, array(x))))"""
    )


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of :func:`contamination`."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item window occurs."""
    found = contamination(docs, items, window, id_col, text_col)
    hit = found.where("n_hit > 0").select("key").distinct()
    whole = packed(docs, doc_id=id_col, text=text_col).withColumn("key", row_key("doc_id", "text"))
    return unpacked(whole.join(hit, "key", "left_anti"), docs.columns)
