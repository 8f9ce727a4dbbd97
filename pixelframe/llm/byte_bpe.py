"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are vocabulary entries as a
whole; every other pre-token is merged by rank with a heap over linked bytes, in O(n log n) of its length, so
a very long pre-token costs no more per byte than a short one. Both tiers run once per distinct pre-token of
a slice; merged ones are kept for a while in a bounded memo of the worker. The pre-tokens of a slice share the arrays
that link their bytes, which are laid out by NumPy, and each has a heap of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.columns import take
from pixelframe.llm.wordhash import hash_runs, mixed
from pixelframe.llm.workers import Recent, map_slices

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of non-empty words (equal words, equal hashes)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return hash_runs(np.frombuffer(b"".join(words), np.uint8).astype(np.uint64), sizes)


_VALUES = 200_000  # ids that become Python objects at once
_LINKED = 1 << 16  # bytes of pre-tokens that are linked at once


class MinimalPerfectHash:
    """Places ``n`` distinct words into ``n`` slots without a collision (hash, displace, and one free slot each
    for the buckets of one word). ``find`` gives the only slot where a word can be; the caller compares."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.buckets = max(1, self.n // 4)
        hashes = hash_words(words)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two words share all 64 bits of their hash")
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        which = (hashes % np.uint64(self.buckets))[order]
        bounds = np.searchsorted(which, np.arange(self.buckets + 1, dtype=np.uint64))
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        singles = []
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = hashes[order[bounds[b] : bounds[b + 1]]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append(b)
                continue
            d, many = 1, 16
            while True:  # many displacements at once: the last buckets need thousands of tries
                slots = self._slots(own, np.arange(d, d + many)[:, None])
                apart = (np.diff(np.sort(slots), axis=1) > 0).all(axis=1)
                fits = np.flatnonzero(apart & ~taken[slots].any(axis=1))
                if len(fits):
                    d, slots = d + int(fits[0]), slots[fits[0]]
                    break
                d, many = d + many, min(4096, many * 4)
            taken[slots] = True
            self.shift[b] = d
        self.shift[singles] = -1 - np.flatnonzero(~taken)[: len(singles)]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = mixed(hashes + shift.astype(np.uint64) * _MULTIPLIER)
        return (moved % np.uint64(self.n)).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        hashes = hash_words(words)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))


class Vocabulary:
    """Ranks of a vocabulary file with lines of base64 bytes and rank, and the pattern that cuts pre-tokens."""

    def __init__(self, path: str, pattern: str, memo_entries: int = 200_000):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(word): int(rank) for word, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.pattern = regex.compile(pattern)
        self.table = MinimalPerfectHash(list(self.ranks))
        self.words: list[bytes] = [b""] * len(self.ranks)
        for word, slot in zip(self.ranks, self.table.find(list(self.ranks)), strict=True):
            self.words[slot] = word
        self.slot_ids = np.array([self.ranks[w] for w in self.words], "<u4")
        self.pieces = {rank: word for word, rank in self.ranks.items()}
        self.memo = Recent(memo_entries)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.full(1 << 16, -1, np.int64)  # rank of two bytes
        for word, rank in self.ranks.items():
            if len(word) == 2:
                self.double[word[0] << 8 | word[1]] = rank

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [self.pattern.findall(text) for text in texts]
        seen = set().union(*cuts)
        found = self.memo.known(seen)
        self.resolve([t for t in seen if t not in found], found)
        return [b"".join([found[t] for t in cut]) for cut in cuts]

    def resolve(self, pre_tokens: list[str], found: dict[str, bytes]) -> None:
        """Put the ids of ``pre_tokens`` into ``found``: first whole words, then what has to be merged."""
        words = [t.encode() for t in pre_tokens]
        group, size = [], 0
        for k, slot in enumerate(self.table.find(words).tolist() if words else ()):
            if self.words[slot] == words[k]:
                found[pre_tokens[k]] = self.slot_ids[slot].tobytes()
                continue
            group.append(k)
            size += len(words[k])
            if size >= _LINKED:
                self._merge_into(found, pre_tokens, words, group)
                group, size = [], 0
        if group:
            self._merge_into(found, pre_tokens, words, group)

    def _merge_into(self, found: dict[str, bytes], pre_tokens: list[str], words: list[bytes], group: list[int]) -> None:
        merged = dict(zip([pre_tokens[k] for k in group], self.merge([words[k] for k in group]), strict=True))
        self.memo.add(merged)
        found.update(merged)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word: merge the adjacent pair of lowest rank, the leftmost on ties, until no pair is in
        the vocabulary. A part is known by where it starts; its end is where the next one starts."""
        text, get = b"".join(words), self.ranks.get
        n, sizes = len(text), np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes)
        shift = n.bit_length()
        place = (1 << shift) - 1
        codes = np.frombuffer(text, np.uint8).astype(np.int64)
        pairs = np.full(n, -1, np.int64)  # rank of the part with the next one
        pairs[:-1] = self.double[codes[:-1] << 8 | codes[1:]]
        pairs[stops - 1] = -1
        at = np.flatnonzero(pairs >= 0)
        owner = np.searchsorted(stops, at, side="right")
        entries = pairs[at] << shift | at
        heaps = entries[np.lexsort((entries, owner))].tolist()  # a sorted list is a heap
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        edges = bytearray(n + 1)
        edges[0] = 1
        for stop in stops.tolist():
            edges[stop] = 1
        rank, ids, alive = pairs.tolist(), self.single[codes].tolist(), bytearray(b"\1" * n)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for a, b in zip(bounds, bounds[1:]):
            heap = heaps[a:b]
            while heap:
                entry = heappop(heap)
                i, r = entry & place, entry >> shift
                if rank[i] != r:
                    continue
                j = ends[i]
                ends[i] = end = ends[j]
                ids[i], alive[j], rank[j] = r, 0, -1
                if edges[end]:
                    rank[i] = -1
                else:
                    before[end] = i
                    rank[i] = r = get(text[i : ends[end]], -1)
                    if r >= 0:
                        heappush(heap, r << shift | i)
                if not edges[i]:
                    h = before[i]
                    rank[h] = r = get(text[h:end], -1)
                    if r >= 0:
                        heappush(heap, r << shift | h)
        kept = np.frombuffer(alive, np.uint8)
        flat = np.array(ids, "<u4")[kept.view(bool)].tobytes()
        cuts = np.append(0, np.cumsum(np.add.reduceat(kept.astype(np.int64), stops - sizes))) * 4
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def decode(self, ids: list[int]) -> list[bytes]:
        """The bytes of each token."""
        try:
            return [self.pieces[i] for i in ids]
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown}") from None


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every text: ``doc_id, n_tokens, ids array<int>``, one row per input row.

    Null texts count as empty (no tokens); repeated rows stay; other columns are left out. ``path`` is
    read by every worker (it belongs to the installed environment), so nothing is sent with the tasks.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = vocabulary(path, pattern)
        coded = coder.encode([t or "" for t in batch.column(1).to_pylist()])
        sizes = np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
        ids = np.frombuffer(b"".join(coded), "<i4")
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"]
        )

    chosen = take(docs, doc_id=id_col, text=text_col)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return map_slices(chosen, run, f"doc_id {kind}, n_tokens bigint, ids array<int>", "text")


def _per_list(lists: pa.ListArray, on_all: Callable, on_each: Callable) -> pa.Array:
    """``on_all`` of the flat values once, ``on_each`` of every list's part of it; null stays null."""
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    valid, rows, a = lists.is_valid().to_numpy(zero_copy_only=False), [], 0
    while a < len(lists):  # so many rows at once that their values stay few
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _VALUES, "right")) - 1)
        flat = on_all(values[bounds[a] : bounds[b]].tolist())
        for i in range(a, b):
            rows.append(on_each(flat[bounds[i] - bounds[a] : bounds[i + 1] - bounds[a]]) if valid[i] else None)
        a = b
    return pa.array(rows, pa.binary())


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    """An expression that turns a column of token ids into the bytes they stand for (null stays null)."""

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        return _per_list(ids, vocabulary(path, pattern).decode, b"".join)

    return decoded


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids as little-endian unsigned 32-bit
    integers and of the bytes that decoding them gives. Ids do not leave the worker, which serves both ways."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = vocabulary(path, pattern)
        sizes, coded, decoded = [], [], []
        for ids in coder.encode([t or "" for t in batch.column(1).to_pylist()]):
            sizes.append(len(ids) // 4)
            coded.append(sha256(ids).hexdigest())
            decoded.append(sha256(b"".join(coder.decode(np.frombuffer(ids, "<u4").tolist()))).hexdigest())
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = take(docs, doc_id=id_col, text=text_col)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_slices(chosen, run, schema, "text")
