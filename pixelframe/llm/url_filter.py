"""URL filtering by a sorted array of digests.

Rules and block-list entries are keys ``host + path``. Their 64-bit xxHash values stand in one sorted array that is
memory-mapped where it is probed; a batch of keys is looked up by one vectorised binary search, and a hit counts only
if the full string stored beside the digest is equal, so collisions do no harm.

A url is looked up in two steps: those suffixes of its host that have as many labels as some known host, then, for the
hosts that are known, the beginnings of its path that have the length of some path known there. So a url costs a
handful of probes however many rules there are.

Up to ``max_bytes`` of rules are built into one array, sent to every executor once as a file, and probed without any
shuffle. Beyond that nothing is sent: distinct probe keys and rules meet in range partitions of their digest, each
partition builds its own part of the array, and the findings are joined back.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import packed, take
from pixelframe.llm.workers import map_slices, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What an entry of a key says, as bits; a key may have several.
ALLOW, BLOCK, LISTED = 1, 2, 4

_OUT = "host string, path string, rule string, verdict string"


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8"), seed=0)


class DigestArray:
    """Sorted digests with their full strings and values in one memory-mapped file."""

    def __init__(self, path: str):
        count = int(np.fromfile(path, dtype=np.int64, count=1)[0])
        at = 8

        def part(kind: type, n: int) -> np.ndarray:
            nonlocal at
            found = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.empty(0, kind)
            at += n * np.dtype(kind).itemsize
            return found

        self.digests = part(np.uint64, count)
        self.starts = part(np.int64, count + 1)
        self.middles = part(np.int64, count)  # where a key ends and its value begins
        self.strings = part(np.uint8, int(self.starts[-1]))

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, str]], hasher: Callable[[str], int] = digest) -> None:
        """Store ``(key, value)`` pairs with distinct keys."""
        digests, keys, values = [], [], []
        for key, value in entries:
            digests.append(hasher(key))
            keys.append(key.encode("utf-8"))
            values.append(value.encode("utf-8"))
        order = np.argsort(np.array(digests, dtype=np.uint64), kind="stable")
        lengths = np.array([len(k) + len(v) for k, v in zip(keys, values)], dtype=np.int64)[order]
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
        middles = starts[:-1] + np.array([len(k) for k in keys], dtype=np.int64)[order]
        with open(path, "wb") as out:
            out.write(np.array([len(keys)], dtype=np.int64).tobytes())
            out.write(np.array(digests, dtype=np.uint64)[order].tobytes())
            out.write(starts.tobytes())
            out.write(middles.astype(np.int64).tobytes())
            for i in order:
                out.write(keys[i])
                out.write(values[i])

    def find(self, keys: Sequence[str], hasher: Callable[[str], int] = digest) -> list[str | None]:
        """The value of each key, or None."""
        if not len(self.digests) or not keys:
            return [None] * len(keys)
        wanted = np.fromiter((hasher(k) for k in keys), dtype=np.uint64, count=len(keys))
        first = np.searchsorted(self.digests, wanted, side="left")
        after = np.searchsorted(self.digests, wanted, side="right")
        found: list[str | None] = [None] * len(keys)
        for i in np.flatnonzero(after > first):
            key = keys[i].encode("utf-8")
            for place in range(first[i], after[i]):  # one entry, or several whose digests collide
                start, middle, end = self.starts[place], self.middles[place], self.starts[place + 1]
                if self.strings[start:middle].tobytes() == key:
                    found[i] = self.strings[middle:end].tobytes().decode("utf-8")
                    break
        return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def entries(rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``key, host, size, bits``: one row per ``host + path`` of rules (``host, path, verdict``) and of a block list
    (``host, path``). Null or empty hosts and unknown verdicts are no rules; a null path counts as empty."""
    verdict = F.when(F.col("verdict") == "allow", ALLOW).when(F.col("verdict") == "block", BLOCK)
    every = take(rules, host="host", path="path", verdict="verdict").select("host", "path", verdict.alias("bits"))
    if listed is not None:
        every = every.unionByName(take(listed, host="host", path="path").withColumn("bits", F.lit(LISTED)))
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    known = every.where((F.col("host") != "") & F.col("bits").isNotNull())
    shaped = known.select(F.concat(host, path).alias("key"), host.alias("host"), F.length(path).alias("size"), "bits")
    return shaped.groupBy("key", "host", "size").agg(F.bit_or("bits").alias("bits"))


def _hosts(known: DataFrame) -> DataFrame:
    """``key, value``: hosts with the lengths of the paths known for them."""
    sizes = F.array_join(F.transform(F.sort_array(F.collect_set("size")), lambda n: n.cast("string")), ",")
    return known.groupBy(F.col("host").alias("key")).agg(sizes.alias("value"))


def judge(
    urls: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    url_col: str = "url",
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """All columns of ``urls`` with ``host, path, rule, verdict`` behind them (a column of such a name that is there
    already stays, so names may repeat).

    A rule (``host, path, verdict`` with ``allow`` or ``block``) fits a url if its host is the url's or a parent of it
    by whole labels, and its path begins the url's path. The longest rule (``host + path``, in code points) decides,
    of equally long ones that with the longer host; of the same rule with both verdicts, block. Where no rule fits,
    a url that fits an entry of ``listed`` (``host, path``, the same way) is blocked and any other allowed.

    Null urls and urls without ``://`` have an empty host and path and fit nothing. Urls of any length are treated
    whole; repeated rows are all answered; an empty table gives an empty result, and without rules and list all is
    allowed. ``max_bytes`` bounds what is collected to the driver and sent to executors; larger lists take the
    partitioned way with the same results.
    """
    known = durable(entries(rules, listed))
    size = known.select(F.sum(F.octet_length("key") + F.octet_length("host") + 64)).first()[0] or 0
    shapes = sorted(r[0] for r in known.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    names = urls.columns
    doc = packed(urls, url=url_col)
    host, path = split_url(F.col("url"))
    split = doc.select("doc", host.alias("host"), path.alias("path"))
    judged = _sent(split, known, shapes) if size <= max_bytes else _partitioned(split, known, shapes)
    own = [F.col(f"doc._{i}").alias(name) for i, name in enumerate(names)]
    return judged.select(*own, "host", "path", "rule", "verdict")


def _suffixes(host: str, shapes: Sequence[int]) -> Iterator[str]:
    """The ends of a host with as many labels as some known host, longest last."""
    dots = [i for i, c in enumerate(host) if c == "."]
    for n in shapes:
        if n == len(dots) + 1:
            yield host
        elif n <= len(dots):
            yield host[dots[len(dots) - n] + 1 :]


def _best(found: Iterable[tuple[str, int, int]]) -> tuple[str | None, str]:
    """Rule and verdict from the fitting entries ``(key, length of host, bits)``."""
    rule, rank, verdict, listed = None, (-1, -1), None, False
    for key, width, bits in found:
        listed = listed or bool(bits & LISTED)
        if bits & (ALLOW | BLOCK) and (len(key), width) > rank:
            rule, rank, verdict = key, (len(key), width), "block" if bits & BLOCK else "allow"
    return rule, verdict or ("block" if listed else "allow")


def _sent(split: DataFrame, known: DataFrame, shapes: Sequence[int]) -> DataFrame:
    """Probe one array that every executor holds as a file."""
    spark = split.sparkSession
    keys = [(r.key, str(r.bits)) for r in known.select("key", "bits").toLocalIterator()]
    hosts = [(r.key, r.value) for r in _hosts(known).toLocalIterator()]
    names = [_send(spark, keys), _send(spark, hosts)]
    opened: list[DigestArray] = []

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not opened:
            opened.extend(DigestArray(SparkFiles.get(name)) for name in names)
        by_key, by_host = opened
        own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path")]
        distinct = list(dict.fromkeys(own[0]))
        ends = {h: list(_suffixes(h, shapes)) for h in distinct}
        asked = list(dict.fromkeys(e for part in ends.values() for e in part))
        sizes = {e: [int(n) for n in v.split(",")] for e, v in zip(asked, by_host.find(asked)) if v is not None}
        probes: list[tuple[int, str, int]] = []
        for i, (h, p) in enumerate(zip(*own)):
            for e in ends[h]:
                probes.extend((i, e + p[:n], len(e)) for n in sizes.get(e, ()) if n <= len(p))
        texts = list(dict.fromkeys(key for _, key, _ in probes))
        value = {t: int(v) for t, v in zip(texts, by_key.find(texts)) if v is not None}
        fits: list[list[tuple[str, int, int]]] = [[] for _ in own[0]]
        for i, key, width in probes:
            if key in value:
                fits[i].append((key, width, value[key]))
        decided = [_best(f) for f in fits]
        columns = [pa.array([d[k] for d in decided], pa.string()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "rule", "verdict"])

    doc = split.schema["doc"].dataType.simpleString()
    return map_slices(split, look, f"doc {doc}, {_OUT}", text="path")


def _send(spark: SparkSession, pairs: list[tuple[str, str]]) -> str:
    """Give all executors a file, under a name that its content decides; equal arrays are sent once."""
    label = hashlib.sha256()
    for pair in sorted(pairs):
        label.update(repr(pair).encode("utf-8"))
    name = f"digests-{label.hexdigest()[:32]}"
    if not any(path.endswith(name) for path in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
        DigestArray.write(path, pairs)
        spark.sparkContext.addFile(path)
    return name


def probe(keys: DataFrame, values: DataFrame, bits: int = 64) -> DataFrame:
    """``key, value`` for the rows of ``keys`` (``key``, distinct) that ``values`` (``key, value``, distinct) knows.

    Both meet in range partitions of the digest (its upper ``bits`` only, if fewer). Values stand before keys in each
    partition: they are spooled to an array on disk, which the keys then probe batch by batch.
    """
    short = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits)
    both = (
        values.select("key", "value")
        .unionByName(keys.select("key", F.lit(None).cast("string").alias("value")))
        .withColumn("at", short)
        .repartitionByRange("at")
        .withColumn("asks", F.col("value").isNull())
        .sortWithinPartitions("asks")
        .select("key", "value", "asks")
    )
    prepare(keys.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "digests")
            array, spooled = None, os.path.join(folder, "pairs")
            with open(spooled, "wb") as raw:
                schema = pa.schema([("key", pa.string()), ("value", pa.string())])
                writer = pa.ipc.new_stream(raw, schema)
                for batch in batches:
                    asks = batch.column(2)
                    split = asks.to_numpy(zero_copy_only=False).searchsorted(True)
                    if split:
                        writer.write_batch(pa.RecordBatch.from_arrays(
                            [batch.column(k).slice(0, split).cast(pa.string()) for k in (0, 1)], schema=schema))
                    if split < batch.num_rows:
                        if array is None:
                            writer.close()
                            raw.flush()
                            array = _from_spool(spooled, path)
                        wanted = batch.column(0).slice(split).to_pylist()
                        found = array.find(wanted)
                        hits = [(k, v) for k, v in zip(wanted, found) if v is not None]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([h[k] for h in hits], pa.string()) for k in (0, 1)], ["key", "value"])
                if array is None:
                    writer.close()

    return both.mapInArrow(run, "key string, value string")


def _from_spool(spooled: str, path: str) -> DigestArray:
    with open(spooled, "rb") as raw:
        pairs = (pair for b in pa.ipc.open_stream(raw) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        DigestArray.write(path, pairs)
    return DigestArray(path)


def _partitioned(split: DataFrame, known: DataFrame, shapes: Sequence[int]) -> DataFrame:
    """Probe in range partitions of the digests, then join the findings back to the urls."""
    places = durable(split.select("host", "path").distinct())
    suffix = F.explode(F.array(*[F.substring_index("host", ".", -n) for n in shapes]) if shapes else F.array().cast("array<string>"))
    ends = places.select("host").distinct().select("host", suffix.alias("key")).distinct()
    sizes = durable(probe(ends.select("key").distinct(), _hosts(known)))
    lengths = F.explode(F.split("value", ",").cast("array<int>"))
    of_host = ends.join(sizes, "key").select("host", F.col("key").alias("end"), lengths.alias("size"))
    asked = durable(
        places.join(of_host, "host")
        .where(F.length("path") >= F.col("size"))
        .select("host", "path", F.length("end").alias("width"), F.concat("end", F.substring(F.col("path"), F.lit(1), F.col("size"))).alias("key"))
    )
    said = durable(probe(asked.select("key").distinct(), known.select("key", F.col("bits").cast("string").alias("value"))))
    bits = F.col("value").cast("int")
    decides = bits.bitwiseAND(ALLOW | BLOCK) != 0
    fits = asked.join(said, "key").groupBy("host", "path").agg(
        F.max(F.when(decides, F.struct(F.length("key").alias("n"), "width", "key", bits.alias("bits")))).alias("best"),
        F.max(bits.bitwiseAND(LISTED) != 0).alias("listed"),
    )
    own = F.when(F.col("best.bits").bitwiseAND(BLOCK) != 0, "block").when(F.col("best").isNotNull(), "allow")
    verdict = F.coalesce(own, F.when(F.col("listed"), "block"), F.lit("allow"))
    answered = durable(fits.select("host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict")))
    joined = durable(split).join(answered, ["host", "path"], "left")
    return joined.select("doc", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
