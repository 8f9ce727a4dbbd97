"""What the Python side of the operators shares: module path of workers, work in small slices, bounded memos."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.workers import prepare

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def release() -> None:
    """Give freed memory back: workers live on, idle, beside those of other stages, and NumPy's pieces stay in the heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    text: str | None = None,
    slice_bytes: int = 1 << 20,
) -> DataFrame:
    """``mapInArrow`` in slices of about ``slice_bytes`` of column ``text``, so that memory stays bounded.

    A single longer text is a slice of its own.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = part = out = None
        try:
            for batch in batches:
                for part in slices(batch, text, slice_bytes):
                    out = function(part)
                    if out is not None:
                        yield out
                release()
        finally:
            del batch, part, out
            release()

    return df.mapInArrow(run, schema)


def text_expression(
    function: Callable[..., pa.Array], kind: str, slice_bytes: int = 1 << 20
) -> Callable[..., Column]:
    """An Arrow expression of a text column (and further ones), evaluated in slices like :func:`map_slices`."""

    if function.__code__.co_argcount == 1:

        @F.arrow_udf(kind)
        def sliced(text: pa.Array) -> pa.Array:
            return _joined([function(p.column(0)) for p in _parts(slice_bytes, text)])

    else:

        @F.arrow_udf(kind)
        def sliced(text: pa.Array, other: pa.Array) -> pa.Array:
            return _joined([function(p.column(0), p.column(1)) for p in _parts(slice_bytes, text, other)])

    return sliced


def _parts(slice_bytes: int, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
    return slices(batch, "0", slice_bytes)


def _joined(parts: list[pa.Array]) -> pa.Array:
    release()
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def slices(batch: pa.RecordBatch, text: str | None, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    if text is None or batch.num_rows == 0:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(text))
    lengths = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    sizes = pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > slice_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)


class Recent:
    """Derived values in two generations, each of at most half of ``limit`` entries (or one addition, if that is more).

    When the younger one is full it becomes the older one, whose entries are forgotten unless they were used since.
    """

    def __init__(self, limit: int):
        self.half = limit // 2
        self.young: dict = {}
        self.old: dict = {}

    def known(self, keys: Iterable) -> dict:
        """The entries of those ``keys`` that are held."""
        young, old, found, again = self.young, self.old, {}, {}
        for key in keys:
            if key in young:
                found[key] = young[key]
            elif key in old:
                again[key] = old[key]
        self.add(again)
        found.update(again)
        return found

    def add(self, values: dict) -> None:
        if len(self.young) + len(values) > self.half:
            self.young, self.old = {}, self.young
        self.young.update(values)
