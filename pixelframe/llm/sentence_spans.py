"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of several consecutive sentences that just reaches ``min_words`` words
is hashed (128 bits of the words, white space apart), and runs meet by hash over the whole corpus. A sentence
goes if it lies in a run that is not the first with its hash; the first stands in the document with the
smallest id, at its smallest place. What remains of a text keeps its own white space. Runs are counted by half of
their hash, and only those that share it move with the whole; of the texts only those that may lose a sentence move,
told by a bit table of fixed size (the join decides).

With ``context``, a single sentence is also hashed with words on one side of it, half of what it lacks to
``long_sentence`` words: a verbatim passage of that length around a whole sentence holds one of the two runs,
wherever the passage cuts the sentences before and after. Scripts written without spaces count two characters
as a word.

White space is that of ASCII. Sentences end at closing punctuation before white space, at full-width stops, at
line breaks, and before a capital letter (so that text pasted into the middle of a sentence still starts one).
Cutting and hashing work on the raw bytes of many texts at once.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import packed, unpacked
from pixelframe.llm.decontamination import bit_table, known
from pixelframe.llm.wordhash import hash_runs, mixed, raw
from pixelframe.llm.workers import map_slices, prepare, text_expression

_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_STOP = np.isin(np.arange(256), list(b".!?;:"))
#: Closing characters of three bytes, the last three of which end a sentence even without white space.
_WIDE_STOPS = [c.encode() for c in "…。！？"]
#: First and last code points of letters that are written without spaces between words.
_UNSPACED = np.array(
    [
        (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF),
        (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
    ]
)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _capitals() -> np.ndarray:
    """Which code points are capital letters."""
    return np.array([unicodedata.category(chr(c)) == "Lu" for c in range(0x110000)])


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at the given bytes."""
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    first, rest = padded[at], [padded[at + k] & 63 for k in (1, 2, 3)]
    return np.select(
        [first < 0x80, first < 0xE0, first < 0xF0],
        [first, (first & 31) << 6 | rest[0], (first & 15) << 12 | rest[0] << 6 | rest[1]],
        (first & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2],
    )


@dataclass
class Sentences:
    """Words and sentences of all rows in order."""

    data: np.ndarray
    bounds: np.ndarray  # of rows in the data
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # first word of every sentence, and the number of words
    rows: np.ndarray  # first sentence of every row, and the number of sentences

    def until(self) -> np.ndarray:
        """Size of everything before each word: one for a word, or half its characters of unspaced scripts."""
        size = np.ones(len(self.starts), np.int64)
        at = np.flatnonzero(self.data >= 0xE0)
        if len(at):
            points = _code_points(self.data, at)
            place = np.searchsorted(_UNSPACED[:, 0], points, "right") - 1
            at = at[(place >= 0) & (points <= _UNSPACED[place, 1])]
            unspaced = np.bincount(np.searchsorted(self.starts, at, "right") - 1, minlength=len(size))
            size = np.maximum(size, (unspaced + 1) // 2)
        return np.append(0, np.cumsum(size))

    def sizes(self) -> np.ndarray:
        return np.diff(self.until()[self.first])


def sentences(column: pa.Array) -> Sentences:
    """Cut every text of a column; null counts as empty."""
    data, bounds = raw(column)
    n = len(data)
    solid = ~_SPACE[data]
    fresh = np.zeros(n + 1, bool)  # places where a word cannot go on
    fresh[bounds] = True
    stops = _STOP[data]
    for stop in _WIDE_STOPS:
        at = np.flatnonzero(data[: max(0, n - 2)] == stop[0])
        at = at[(data[at + 1] == stop[1]) & (data[at + 2] == stop[2])]
        stops[at + 2] = True
        if stop != _WIDE_STOPS[0]:
            fresh[at + 3] = True
    if n:
        starts = np.flatnonzero(solid & (fresh[:-1] | np.append(True, ~solid[:-1])))
        ends = np.flatnonzero(solid & (fresh[1:] | np.append(~solid[1:], True))) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    lines = np.append(0, np.cumsum(data == 10))
    opens = np.ones(len(starts), bool)
    if len(starts):
        capital = _capitals()[_code_points(data, starts[1:])]
        broken = lines[starts[1:]] > lines[ends[:-1]]
        opens[1:] = stops[ends[:-1] - 1] | capital | broken
        opens[np.searchsorted(starts, bounds[:-1])[np.searchsorted(starts, bounds[:-1]) < len(starts)]] = True
    first = np.append(np.flatnonzero(opens), len(starts))
    rows = np.searchsorted(starts[first[:-1]], bounds)
    return Sentences(data, bounds, starts, ends, first, rows)


def runs(
    sizes: np.ndarray, rows: np.ndarray, min_words: int, min_sentences: int, long_sentence: int
) -> np.ndarray:
    """``(first, after last)`` of the runs inside a row that cannot lose a sentence at one of their ends.

    A run has ``min_words`` words and ``min_sentences`` sentences at least; one sentence of ``long_sentence``
    words is a run of its own.
    """
    n = len(sizes)
    until = np.append(0, np.cumsum(sizes))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    first = np.arange(n)
    after = np.maximum(np.searchsorted(until, until[:-1] + min_words), first + min_sentences)
    before = np.minimum(np.searchsorted(until, until[1:] - min_words, "right") - 1, first + 1 - min_sentences)
    long = np.flatnonzero(sizes >= long_sentence)
    pairs = np.concatenate(
        [
            np.stack([first, after], 1)[after <= rows[1:][row]],
            np.stack([before, first + 1], 1)[before >= rows[:-1][row]],
            np.stack([long, long + 1], 1),
        ]
    )
    code = np.unique(pairs[:, 0] * (n + 1) + pairs[:, 1])
    return np.stack([code // (n + 1), code % (n + 1)], 1)


def context_runs(
    found: Sentences, min_words: int, min_sentences: int, long_sentence: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences, ``(first, after last)`` word of each with half of what it lacks on one side, and the side.

    The side (1 right, 2 left) tells runs of the same words in one place apart.

    Left out where a run of whole sentences from (or up to) that sentence lies inside, since it meets as well.
    """
    until, first, rows = found.until(), found.first, found.rows
    low, high = until[first[:-1]], until[first[1:]]
    reach = (high - low + long_sentence + 1) // 2
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    begin, end = first[rows[:-1]][row], first[rows[1:]][row]
    k = np.arange(len(row))
    sums = until[first]
    after = np.maximum(np.searchsorted(sums, low + min_words), k + min_sentences)
    before = np.minimum(np.searchsorted(sums, high - min_words, "right") - 1, k + 1 - min_sentences)
    right = np.searchsorted(until, low + reach)
    left = np.searchsorted(until, high - reach, "right") - 1
    short = high - low < long_sentence
    met_right = (after <= rows[1:][row]) & (first[np.minimum(after, len(row))] < right)
    met_left = (before >= rows[:-1][row]) & (first[np.maximum(before, 0)] > left)
    a = np.flatnonzero(short & (right <= end) & ~met_right)
    b = np.flatnonzero(short & (left >= begin) & ~met_left)
    words = np.concatenate([np.stack([first[a], right[a]], 1), np.stack([left[b], first[b + 1]], 1)])
    return np.concatenate([a, b]), words, np.repeat([1, 2], [len(a), len(b)])


def run_hashes(found: Sentences, own: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of the words of every run of sentences."""
    return word_hashes(found, found.first[own])


def word_hashes(found: Sentences, own: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of every run of words."""
    solid = np.zeros(len(found.data) + 1, np.int8)
    solid[found.starts] += 1
    solid[found.ends] -= 1
    inside = np.cumsum(solid[:-1]) > 0
    words = hash_runs(found.data[inside].astype(np.uint64), found.ends - found.starts)
    a, b = own[:, 0], own[:, 1]
    out = []
    for m in _MULTIPLIERS:
        powers, undo = (
            np.cumprod(np.append(np.uint64(1), np.full(len(words), x, np.uint64)), dtype=np.uint64)
            for x in (np.uint64(m), np.uint64(pow(m, -1, 1 << 64)))
        )
        sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1], dtype=np.uint64))
        out.append(mixed((sums[b] - sums[a]) * undo[a] + (b - a).astype(np.uint64)).view(np.int64))
        words = mixed(words + np.uint64(m))
    return out


def spans(
    docs: DataFrame, min_words: int, min_sentences: int, long_sentence: int, context: bool = False
) -> DataFrame:
    """``key, doc_id, first, after, h1, h2``: every run of every text of ``docs`` (``key, doc_id, text``)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sentences(batch.column(2))
        own = runs(found.sizes(), found.rows, min_words, min_sentences, long_sentence)
        words, whole = found.first[own], len(own)
        if context:
            alone, around, side = context_runs(found, min_words, min_sentences, long_sentence)
            own = np.concatenate([own, np.stack([alone, alone + 1], 1)])
            words = np.concatenate([words, around])
        hashes = word_hashes(found, words)
        if context:
            hashes[0][whole:] ^= side
        row = np.searchsorted(found.rows, own[:, 0], "right") - 1
        inside = (own - found.rows[row][:, None]).astype(np.int32)
        taken = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(taken),
                batch.column(1).take(taken),
                pa.array(np.ascontiguousarray(inside[:, 0])),
                pa.array(np.ascontiguousarray(inside[:, 1])),
                *map(pa.array, hashes),
            ],
            ["key", "doc_id", "first", "after", "h1", "h2"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key bigint, doc_id {kind}, first int, after int, h1 bigint, h2 bigint"
    return map_slices(docs, run, schema, "text")


def remove_repeats(
    docs: DataFrame,
    min_words: int = 20,
    min_sentences: int = 2,
    long_sentence: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    context: bool = False,
) -> DataFrame:
    """``doc_id, n_sentences, n_removed, text``: each row with the sentences that it is left with.

    A text without repeats stays as it is, byte for byte; a null text stays null, with no sentences. Rows that
    agree in id and text count as one document and get the same result; a null id comes first.
    """
    found = _cut(docs, min_words, min_sentences, long_sentence, id_col, text_col, context)
    return found.select("doc_id", "left.n_sentences", "left.n_removed", "left.text")


def rewrite(
    docs: DataFrame,
    min_words: int = 20,
    min_sentences: int = 2,
    long_sentence: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    context: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts as :func:`remove_repeats` leaves them.

    The length column, if there is one, follows the text; rows left without any text by a removal go.
    """
    found = _cut(docs, min_words, min_sentences, long_sentence, id_col, text_col, context)
    found = found.where("left.n_removed = 0 OR left.text != ''")
    length = F.when(F.col("left.n_removed") > 0, F.length("left.text"))
    changed = {text_col: F.col("left.text")}
    if length_col in docs.columns:
        place = docs.columns.index(length_col)
        old = F.col(f"doc._{place}")
        changed[length_col] = F.coalesce(length.cast(docs.schema[place].dataType), old)
    return unpacked(found, docs.columns, **changed)


def _cut(docs, min_words, min_sentences, long_sentence, id_col, text_col, context) -> DataFrame:
    """``doc, doc_id, left struct<n_sentences, n_removed, text>`` for every row."""
    prepare(docs.sparkSession)
    whole = packed(docs, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    found = spans(whole.select("key", "doc_id", "text"), min_words, min_sentences, long_sentence, context)
    shared = durable(found.groupBy("h1").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h1"))
    met = durable(found.join(shared, "h1"))  # half of the hash selects, the whole decides
    place = F.struct("doc_id", "key", "first")  # a null id comes first
    origins = durable(met.groupBy("h1", "h2").agg(F.min(place).alias("origin")))
    gone = durable(
        met.join(origins, ["h1", "h2"])
        .where(~place.eqNullSafe(F.col("origin")))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("first", "after")).alias("ranges"))
    )
    table = bit_table(gone.select(F.col("key").alias("h")))
    whole = whole.drop("text")

    @F.arrow_udf("boolean")
    def concerned(keys: pa.Array) -> pa.Array:
        return pa.array(known(table, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    a, b = whole.where(concerned("key")).alias("a"), gone.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    ranges = F.lit(None).cast(gone.schema["ranges"].dataType).alias("ranges")
    others = whole.where(~concerned("key")).select("doc", "doc_id", ranges)  # texts that stay need not move
    marked = others.unionByName(a.join(b, same, "left").select("a.doc", "a.doc_id", "b.ranges"))

    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        found, out, removed = sentences(texts), texts.to_pylist(), np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)).tolist():
            away = np.zeros(found.rows[i + 1] - found.rows[i], bool)
            for x in ranges[i].as_py():
                away[x["first"] : x["after"]] = True
            removed[i] = away.sum()
            out[i] = without(found, i, away)
        columns = [pa.array(np.diff(found.rows), pa.int64()), pa.array(removed), pa.array(out, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_sentences", "n_removed", "text"])

    kind = "struct<n_sentences: bigint, n_removed: bigint, text: string>"
    text = F.col(f"doc._{docs.columns.index(text_col)}")
    return marked.select("doc", "doc_id", text_expression(cut, kind)(text, F.col("ranges")).alias("left"))


def without(found: Sentences, row: int, away: np.ndarray) -> str:
    """The text of a row less the marked sentences, each with the white space after it."""
    a, b = found.rows[row], found.rows[row + 1]
    edges = [*found.starts[found.first[a:b]].tolist(), int(found.bounds[row + 1])]
    kept = [found.data[x:y].tobytes() for x, y, gone in zip(edges, edges[1:], away) if not gone]
    before = found.data[found.bounds[row] : edges[0]].tobytes()
    return (before + b"".join(kept)).rstrip().decode() if kept else ""
