"""The exact self-join of items by their frames: items are written once, and tasks read them by two.

Nothing is shuffled. The items are one staged table; its files are cut into pieces of rows. A task holds one piece and
streams a file past it, so on disk there is each frame once, and in memory one piece and one batch. All frames of an
item are in one row: what is said of two items is found in the one task in which they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.functions.bits import LEAST_BITS, MOST_BITS

#: Frames of a piece, rows of a batch, frames of each side of one product, pairs of hashes compared at a time.
PIECE, BATCH, TILE, COMPARED = 32_768, 2048, (1024, 512), 4_000_000
#: What single precision may take from a cosine.
SLACK = 2e-5
FAR = 65


class Items(NamedTuple):
    """Rows of the table; first: place of the first row in its file. Frames and hashes lie one after another."""

    first: int
    path: pa.Array
    frames: np.ndarray
    owner: np.ndarray
    unit: np.ndarray
    single: np.ndarray
    hashes: np.ndarray
    hashed: np.ndarray


def unit_rows(vectors: np.ndarray, mean: list[float] | None) -> np.ndarray:
    """Vectors as doubles less the mean, at unit length; one equal to the mean stays zero. Without a mean as they are."""
    vectors = vectors.astype(np.float64)
    if mean is None:
        return vectors
    vectors -= np.array(mean)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)


def items_of(rows: pa.Table | pa.RecordBatch, first: int, mean: list[float] | None) -> Items:
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    path, vector = whole(rows.column("path")), whole(rows.column("vector"))
    frames = pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vector.flatten()
    unit = unit_rows(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1), mean)
    hashes, hashed = np.zeros(0, np.uint64), np.zeros(len(path), np.int64)
    if "dhash" in rows.schema.names:
        listed = whole(rows.column("dhash"))
        of, some = pc.list_parent_indices(listed).to_numpy(zero_copy_only=False), listed.flatten()
        good = some.is_valid().to_numpy(zero_copy_only=False)
        hashes = some.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        count = np.bitwise_count(hashes)
        good &= (count >= LEAST_BITS) & (count <= MOST_BITS)
        hashes, hashed = hashes[good], np.bincount(of[good], minlength=len(path)).astype(np.int64)
    return Items(first, path, frames, np.repeat(np.arange(len(path)), frames), unit, unit.astype(np.float32), hashes, hashed)


def near_frames(left: Items, right: Items, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames of left, of right, cosines): those of at least `least`; within one file of an earlier row left.

    Products are taken in single precision; what comes near the bar is measured again in double precision.
    """
    found: list[tuple[np.ndarray, ...]] = []
    high, wide = TILE
    room, marks = np.empty(high * wide, np.float32), np.zeros(high * wide + 8, bool)
    for at in range(0, len(right.unit), wide):
        part = right.single[at : at + wide].T
        last = right.first + right.owner[at + part.shape[1] - 1]
        for lo in range(0, len(left.unit), high):
            if same and left.first + left.owner[lo] >= last:
                break
            block = left.single[lo : lo + high]
            n = len(block) * part.shape[1]
            dots = np.matmul(block, part, out=room[:n].reshape(len(block), -1))
            np.greater_equal(dots.ravel(), least - SLACK, out=marks[:n])
            marks[n : n + 8] = False
            eight = np.flatnonzero(marks[: -(-n // 8) * 8].view(np.uint64) != 0)  # few are near: most eights are passed over
            near = (eight[:, None] * 8 + np.arange(8)).ravel()
            p, q = np.divmod(near[marks[near]], part.shape[1])
            p, q = p + lo, q + at
            if same:
                keep = left.first + left.owner[p] < right.first + right.owner[q]
                p, q = p[keep], q[keep]
            cos = np.einsum("ij,ij->i", left.unit[p], right.unit[q])
            keep = cos >= least
            found.append((p[keep], q[keep], cos[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def fewest_bits(left: Items, right: Items, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of items, the fewest bits by which a hash of one differs from one of the other; FAR if a side has none."""
    bits = np.full(len(a), FAR, np.int64)
    from_a, from_b = np.cumsum(left.hashed) - left.hashed, np.cumsum(right.hashed) - right.hashed
    each = left.hashed[a] * right.hashed[b]
    some = np.flatnonzero(each)
    slab = (np.cumsum(each[some]) - 1) // COMPARED
    for rows in np.split(some, np.flatnonzero(np.diff(slab)) + 1) if len(some) else ():
        many, starts = each[rows], np.cumsum(each[rows]) - each[rows]
        k = np.arange(many.sum()) - np.repeat(starts, many)
        one, other = np.repeat(a[rows], many), np.repeat(b[rows], many)
        i, j = np.divmod(k, right.hashed[other])
        bits[rows] = np.minimum.reduceat(np.bitwise_count(left.hashes[from_a[one] + i] ^ right.hashes[from_b[other] + j]), starts)
    return bits


def met(left: Items, right: Items, same: bool, least: float, matched: float, gated: bool) -> tuple[np.ndarray, ...]:
    """(items of left, items of right, peak, coverage, multi) of the pairs of items that have a pair of frames.

    The matched frames of a side are those with a partner of at least `matched`; coverage is the smaller number over
    the smaller frame count. Two single frames have coverage 1, as have all pairs if not gated.
    """
    p, q, cos = near_frames(left, right, same, least)
    key = left.owner[p] * len(right.path) + right.owner[q]
    order = np.argsort(key, kind="stable")
    p, q, cos, key = p[order], q[order], cos[order], key[order]
    pairs, starts, group = np.unique(key, return_index=True, return_inverse=True)
    a, b = np.divmod(pairs, max(1, len(right.path)))
    peak = np.maximum.reduceat(cos, starts) if len(starts) else cos
    multi = ((left.frames[a] > 1) | (right.frames[b] > 1)) & gated
    covered = np.flatnonzero((cos >= matched) & multi[group])
    sides = []
    for frame in (p, q):
        pair = np.unique(np.stack([group[covered], frame[covered]]), axis=1)[0] if len(covered) else np.zeros(0, np.int64)
        sides.append(np.bincount(pair, minlength=len(pairs)))
    coverage = np.where(multi, np.minimum(*sides) / np.minimum(left.frames[a], right.frames[b]), 1.0)
    return a, b, peak, coverage, multi


def read_rows(file: str, lo: int, hi: int | None, columns: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(place of the first row, batch) of the rows from lo to hi of a Parquet file."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    file = file.replace("s3a://", "s3://", 1)
    system, path = fs.FileSystem.from_uri(file) if ":/" in file else (fs.LocalFileSystem(), file)
    at = 0
    with system.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(BATCH, columns=columns):
            start, end = max(lo - at, 0), batch.num_rows if hi is None else min(hi - at, batch.num_rows)
            if start < end:
                yield at + start, batch.slice(start, end - start)
            at += batch.num_rows
            if hi is not None and at >= hi:
                break


def by_pieces(held: DataFrame, least: float, prefilter: float, matched: float, cost: float, gated: bool, mean: list[float] | None, reach: tuple[float, float, int] | None = None) -> DataFrame:
    """(a, b, peak, coverage, multi, sim, bits), a < b: all pairs of items with a peak of at least the prefilter.

    held: a staged table (path, vector, and dhash if there is a reach), a row a path. Pairs of frames count from `least`.
    With a reach (sim, lower sim, bits), pairs go on with a sim of at least the first, or with the second and no
    more bits than the third; without, bits are null.
    """
    spark, columns = held.sparkSession, ["path", "vector"] + ["dhash"] * bool(reach)
    counted = held.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("frames")).orderBy("file").collect()
    cores, total = spark.sparkContext.defaultParallelism, sum(r.frames for r in counted)
    piece = min(PIECE, max(1024, total // (2 * cores)))
    files, cuts = [r.file for r in counted], []
    for i, r in enumerate(counted):
        many = max(1, round(r.frames / piece))  # so files a little larger than a piece are not read twice as often
        cuts += [(i, r.n * k // many, r.n * (k + 1) // many) for k in range(many)]
    #: The tasks of a piece are those files that come no earlier than its own.
    ends = np.cumsum([len(files) - i for i, _, _ in cuts], dtype=np.int64)
    n = int(ends[-1]) if cuts else 0

    def join(batches):
        now, left = None, None
        for batch in batches:
            for task in batch.column("id").to_pylist():
                cut = int(np.searchsorted(ends, task, side="right"))
                i, lo, hi = cuts[cut]
                other = len(files) - int(ends[cut] - task)
                if now != cut:
                    parts = list(read_rows(files[i], lo, hi, columns))
                    now, left = cut, items_of(pa.Table.from_batches([x for _, x in parts]), lo, mean) if parts else None
                if left is None:
                    continue
                for first, rows in read_rows(files[other], lo if other == i else 0, None, columns):
                    yield from said(left, items_of(rows, first, mean), other == i)

    def said(left: Items, right: Items, same: bool) -> Iterator[pa.RecordBatch]:
        a, b, peak, coverage, multi = met(left, right, same, least, matched, gated)
        sim = peak - cost * (1 - coverage)
        keep = peak >= prefilter
        bits = None
        if reach:
            keep &= sim >= min(reach[:2])
            a, b, peak, coverage, multi, sim = (x[keep] for x in (a, b, peak, coverage, multi, sim))
            bits = fewest_bits(left, right, a, b)
            keep = (sim >= reach[0]) | ((sim >= reach[1]) & (bits <= reach[2]))
            bits = bits[keep]
        a, b, peak, coverage, multi, sim = (x[keep] for x in (a, b, peak, coverage, multi, sim))
        x, y = left.path.take(pa.array(a)), right.path.take(pa.array(b))
        swap, differ = pc.greater(x, y), pc.not_equal(x, y)
        bits = pa.nulls(len(a), pa.int32()) if bits is None else pa.array(bits, pa.int32(), mask=bits == FAR)
        made = [pc.if_else(swap, y, x), pc.if_else(swap, x, y), *map(pa.array, (peak, coverage, multi, sim)), bits]
        out = pa.RecordBatch.from_arrays(made, names=["a", "b", "peak", "coverage", "multi", "sim", "bits"]).filter(differ)
        if out.num_rows:
            yield out

    tasks = spark.range(0, n, 1, max(1, min(n, max(cores, 1000))))
    return tasks.mapInArrow(join, "a string, b string, peak double, coverage double, multi boolean, sim double, bits int")
