"""Exact Euclidean distances inside planes, for many planes of one shape at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pixels worked on at once, or one plane if that is more.
SLICE = 1 << 18


def _down(masks: np.ndarray) -> np.ndarray:
    """Steps to the nearest background pixel of the same column; height + width where there is none."""
    n, h, w = masks.shape
    y = np.arange(h)[None, :, None]
    above = np.maximum.accumulate(np.where(masks, -(h + w), y), axis=1)
    below = np.minimum.accumulate(np.where(masks, 2 * h + w, y)[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(np.minimum(y - above, below - y), h + w)


def squares(masks: np.ndarray) -> np.ndarray:
    """Squared distances of ``masks (n, h, w)`` to the nearest background pixel, -1 where a plane has none.

    The nearest columns never fall along a line. So they are found for every other place in turn, by halving strides,
    and each is sought between those of its two neighbours: all searches of a stride pass over the lines once.
    """
    n, h, w = masks.shape
    steps = _down(masks).reshape(n * h, w).astype(np.int64)
    costs = steps * steps
    rows = np.arange(n * h)[:, None]
    nearest = np.zeros((n * h, w), np.int64)
    best = np.zeros((n * h, w), np.int64)

    def seek(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        sizes = (high - low + 1).ravel()
        starts = np.append(0, np.cumsum(sizes)[:-1])
        column = np.arange(sizes.sum()) + np.repeat(low.ravel() - starts, sizes)
        line = np.repeat(np.broadcast_to(rows, low.shape).ravel(), sizes)
        away = column - np.repeat(np.broadcast_to(x, low.shape).ravel(), sizes)
        found = np.minimum.reduceat((costs[line, column] + away * away) * w + column, starts).reshape(low.shape)
        nearest[:, x], best[:, x] = found % w, found // w

    ends = np.zeros((n * h, 1), np.int64)
    seek(np.array([0]), ends, ends + w - 1)
    stride = 1 << max(0, int(w - 1).bit_length() - 1)
    while stride and w > 1:
        x = np.arange(stride, w, 2 * stride)
        after = np.where(x + stride < w, nearest[:, np.minimum(x + stride, w - 1)], w - 1)
        seek(x, nearest[:, x - stride], after)
        stride //= 2
    bare = masks.all(axis=(1, 2))
    out = best.reshape(n, h, w)
    out[bare] = -1
    return out


def _masks(column: pa.Array, h: int, w: int) -> np.ndarray:
    """Masks of one shape; nulls and pixels that are missing at the end are background, those too many are left out."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    own = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    flat = pc.fill_null(own, False).to_numpy(zero_copy_only=False)
    offsets, sizes = offsets - offsets[0], np.diff(offsets)
    if (sizes == h * w).all():
        return flat.reshape(-1, h, w)
    at = np.arange(h * w)
    there = at < sizes[:, None]
    padded = np.append(flat, False)
    return (padded[np.where(there, offsets[:-1, None] + at, len(flat))] & there).reshape(-1, h, w)


def _slices(h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring planes of one shape with about ``SLICE`` pixels."""
    start = 0
    for i in range(1, len(h) + 1):
        if i == len(h) or (h[i], w[i]) != (h[start], w[start]) or (i + 1 - start) * h[start] * w[start] > SLICE:
            yield start, i
            start = i


def _distances(column: pa.Array, h: int, w: int) -> pa.Array:
    n = len(column)
    if h * w == 0:
        values = pa.array([], pa.float64())
    else:
        found = squares(_masks(column, h, w)).ravel()
        values = pa.array(np.sqrt(np.maximum(found, 0)), pa.float64(), mask=found < 0)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (h * w), pa.int32())
    missing = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(offsets, values, mask=missing)


def with_distances(batches: Iterator[pa.RecordBatch], mask: str) -> Iterator[pa.RecordBatch]:
    """Batches of planes with ``distance`` appended; they leave in slices, so that memory stays bounded."""
    for batch in batches:
        h, w = (
            pc.fill_null(batch.column(batch.schema.get_field_index(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in ("height", "width")
        )
        masks = batch.column(batch.schema.get_field_index(mask))
        for a, b in _slices(h, w):
            found = _distances(masks.slice(a, b - a), int(h[a]), int(w[a]))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, found], schema=part.schema.append(pa.field("distance", found.type)))
