"""Kernels over pictures: sharpness, static watermarks, letterbox bars, frame hashes.

A picture is a luminance grid of one shape; kernels take a stack of pictures of equal shape and give a number for
each. Columns of grids (array<array<double>>, row by row) reach them through Arrow, all of a batch that share a shape
at once. The decoders that make pictures from files are in `lookalike.sources.media`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[[np.ndarray], np.ndarray]

# Fixed values of the scores.
BLOCKS = 4
MOVING, STILL, EDGE, LEAST_FRAMES = 8.0, 0.35, 18.0, 3
DARK, LEAST_LIT = 8.0, 0.40


def second_differences(stack: np.ndarray) -> np.ndarray:
    """The four neighbours of each pixel less four times the pixel; borders are mirrored about the edge pixel."""
    total = -4.0 * stack
    for axis in (1, 2):
        n = stack.shape[axis]
        for step in (-1, 1):
            at = np.arange(n) + step
            at = np.clip(np.where(at < 0, -at, np.where(at >= n, 2 * n - 2 - at, at)), 0, n - 1)
            total += stack.take(at, axis=axis)
    return total


def sharpness(stack: np.ndarray) -> np.ndarray:
    """Greatest variance of the second differences in a block of a 4 x 4 partition. What the partition leaves over at
    the right and bottom is passed over, as are blocks of a single pixel; without any other block it is 0."""
    lap = second_differences(stack)
    height, width = (max(1, n // BLOCKS) for n in stack.shape[1:])
    best = np.zeros(len(stack))
    for top in range(0, min(stack.shape[1], BLOCKS * height), height):
        for left in range(0, min(stack.shape[2], BLOCKS * width), width):
            block = lap[:, top : top + height, left : left + width]
            if block[0].size >= 2:
                best = np.maximum(best, block.var(axis=(1, 2)))
    return best


def static_share(films: np.ndarray) -> np.ndarray:
    """Share of pixels that stay still over time and lie on an edge: a burnt-in mark. films: (film, frame, y, x).

    An edge is a step to the pixel on the right or below; it counts for the pixel on the left or above. Films of
    fewer than 3 frames, and those in which hardly anything moves, score 0."""
    if films.shape[1] < LEAST_FRAMES:
        return np.zeros(len(films))
    spread, mean = films.std(axis=1), films.mean(axis=1)
    motion = spread.mean(axis=(1, 2))
    step = np.zeros_like(mean)
    step[:, :, :-1] += np.abs(np.diff(mean, axis=2))
    step[:, :-1, :] += np.abs(np.diff(mean, axis=1))
    share = ((spread < STILL * motion[:, None, None]) & (step > EDGE)).mean(axis=(1, 2))
    return np.where(motion < MOVING, 0.0, share)


def lit_ratio(stack: np.ndarray) -> np.ndarray:
    """Share of the picture inside dark bars; 1 where it is improbably small, as of a dark picture."""
    lit = [(stack.mean(axis=axis) > DARK).mean(axis=1) for axis in (1, 2)]
    ratio = lit[0] * lit[1]
    return np.where(ratio >= LEAST_LIT, ratio, 1.0)


def area_weights(size: int, to: int) -> np.ndarray:
    """(to, size): how much of each source cell a target cell averages."""
    edges = np.linspace(0, size, to + 1)
    low, high = np.maximum(edges[:-1, None], np.arange(size)), np.minimum(edges[1:, None], np.arange(1, size + 1))
    part = np.clip(high - low, 0, None)
    return part / part.sum(axis=1, keepdims=True)


def shrink(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resize of every picture; colours, if any, are the last axis."""
    rows, columns = area_weights(stack.shape[1], height), area_weights(stack.shape[2], width)
    if stack.ndim == 3:
        return rows @ stack @ columns.T
    return np.stack([rows @ stack[..., c] @ columns.T for c in range(stack.shape[3])], axis=3)


def frame_hash(stack: np.ndarray) -> np.ndarray:
    """64 bits of each picture at 9 x 8, row by row, first bit highest: whether a cell is brighter than the one left of it."""
    small = shrink(stack, 8, 9).round(9)
    bits = (small[:, :, 1:] > small[:, :, :-1]).reshape(len(stack), 64)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def rectangles(column: pa.ListArray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, array) for the rows of a nested list column whose lists form a full box, those of one shape together.
    Null, empty and ragged rows are in none."""
    rows = len(column)
    shape, good = np.zeros((rows, depth), np.int64), np.ones(rows, bool)
    owner, values = np.arange(rows), column
    for level in range(depth):
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        least, most = np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int64)
        np.minimum.at(least, owner, sizes)
        np.maximum.at(most, owner, sizes)
        good &= (least == most) & (most > 0)
        shape[:, level] = most
        owner, values = np.repeat(owner, sizes), values.flatten()
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.searchsorted(owner, np.arange(rows))
    for one in np.unique(shape[good], axis=0):
        own = np.flatnonzero(good & (shape == one).all(axis=1))
        yield own, numbers[first[own][:, None] + np.arange(one.prod())].reshape(len(own), *one)


#: Kernels by name: the kernel, the depth of its column, its type, what a row without a full box gets.
KERNELS: dict[str, tuple[Kernel, int, T.DataType, object]] = {
    "sharpness": (sharpness, 2, T.DoubleType(), 0.0),
    "content_ratio": (lit_ratio, 2, T.DoubleType(), 1.0),
    "dhash": (frame_hash, 2, T.LongType(), None),
    "watermark": (static_share, 3, T.DoubleType(), 0.0),
}


def measured(pictures: DataFrame, column: str, *names: str) -> DataFrame:
    """The other columns of the frame, and the named kernels of the column of pictures, or of films for watermark.

    A row whose column is null, empty or ragged gets what stands for a missing picture; an empty frame gives no rows."""
    keep = [c for c in pictures.columns if c != column]
    fields = [T.StructField(n, KERNELS[n][2]) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = []
            for name in names:
                kernel, depth, kind, missing = KERNELS[name]
                out = np.full(batch.num_rows, 0 if missing is None else missing, np.float64 if isinstance(kind, T.DoubleType) else np.int64)
                known = np.full(batch.num_rows, missing is not None)
                for rows, stack in rectangles(batch.column(column), depth):
                    out[rows], known[rows] = kernel(stack), True
                results.append(pa.array(out, mask=~known))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *results], names=[*keep, *names])

    return pictures.mapInArrow(run, T.StructType([*(pictures.schema[c] for c in keep), *fields]))
