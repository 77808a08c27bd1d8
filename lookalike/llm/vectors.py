"""Frame vectors of catalog records: contents, cross-polytope buckets, exact verification.

A record's content is its list of frames in its mode. A content takes part if the list is neither
null nor empty and every frame has the stated width, finite values and is not all zero. Contents
are named by a 64-bit hash of mode and frames: equal contents are handled once, however many
records carry them; two different ones share a name with probability n * n / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.catalog import current_rows
from lookalike.session import shuffle_partitions, stage_table

DIMS = 64
MODES = ("visual", "faces")
#: Rows of one bucket from which it is hot, and frames in a block of a hot bucket.
HOT_BUCKET = 2000
#: One content in so many is looked at to foresee hot buckets.
FORESEEN = 16
#: Coordinates of a sketch; a coordinate counts as large beyond LARGE standard deviations.
SKETCH, LARGE = 64, 0.98
#: Share of the pairs at the bar itself that the sketches may lose.
SKETCH_LOSS = 1e-4
#: Widths up to which a rotation is one matrix product; wider ones go through the butterflies.
DENSE = 128


@dataclass(frozen=True)
class Shape:
    """Of the index: hash tables, hash functions joined in a bucket's name, buckets visited per table.

    The same at every size. With 3 functions a bucket of one of 2**21 has about as many chance mates at
    10**8 frames as one of 2**14, that of 2 functions, at 10**6; for 10**10 frames ask for 4 functions.
    """

    tables: int = 5
    functions: int = 3
    probes: int = 8
    #: Tables whose rows are shuffled at once: what bounds the disk.
    at_once: int = 2


def own_frames() -> Column:
    return F.when(F.col("mode") == MODES[0], F.col("vector")).when(F.col("mode") == MODES[1], F.col("faces"))


def content_id(dims: int) -> Column:
    """Null where a frame is missing or of another width; other frames that take no part get a name too,
    which no usable content has, as hashes differ with mode, number of frames and values."""
    frames = own_frames()
    wide = (F.size(frames) > 0) & F.forall(frames, lambda f: F.size(f) == dims)
    return F.when(wide, F.xxhash64("mode", F.size(frames), frames))


def usable_frames(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their frame counts, their frames stacked as float32)."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    widths = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    good = widths == dims
    starts = np.cumsum(widths) - widths
    if good.all():
        frames = values.reshape(-1, dims)
    else:
        frames = np.zeros((len(widths), dims), np.float32)
        at = np.flatnonzero(good)
        frames[at] = values[starts[at][:, None] + np.arange(dims)]
    good &= np.isfinite(frames).all(axis=1) & (frames != 0).any(axis=1)
    row = np.repeat(np.arange(len(counts)), counts)
    bad = np.bincount(row[~good], minlength=len(counts))
    rows = np.flatnonzero((counts > 0) & (bad == 0))
    return rows, counts[rows], frames[np.isin(row, rows)] if len(rows) < len(counts) else frames


def contents(catalog: DataFrame, dims: int = DIMS) -> tuple[DataFrame, DataFrame]:
    """(current, packed): current (mode, path, cid) of the current records that take part, and packed
    (cid, mode, frames), the frames of each of their contents, once. Both are staged.

    Only directions matter, so a frame travels as 16-bit integers, scaled to its greatest value: half the
    bytes to shuffle, and cosines of frames read back differ from exact ones by less than 2e-5.
    Names are hashed in the scan and vectors of older writes are left out before anything is compared.
    """
    read = catalog.where(F.col("mode").isin(*MODES)).withColumn("cid", content_id(dims))
    records = stage_table(current_rows(read, ["cid"]).where(F.col("cid").isNotNull()), "records")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts, frames = usable_frames(batch.column("frames"), dims)
            ids = batch.column("cid").to_numpy()[rows]
            # Contents repeated within a batch go at once, so that a group of copies is thinned before the shuffle.
            _, at = np.unique(ids, return_index=True)
            keep = np.zeros(len(ids), bool)
            keep[at] = True
            rows, counts, frames = rows[keep], counts[keep], frames[np.repeat(keep, counts)]
            ends = np.concatenate([[0], np.cumsum(counts)]) * dims * 2
            short = np.rint(frames / np.abs(frames).max(axis=1, keepdims=True) * np.float32(32767)).astype(np.int16)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(short.tobytes())])
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(taken), batch.column("number").take(taken), packed], names=["cid", "mode", "frames"])

    number = F.when(F.col("mode") == MODES[0], 0).otherwise(1)
    lists = read.where(F.col("cid").isNotNull()).select("cid", number.alias("number"), own_frames().alias("frames"))
    # Partitioned first: one shuffle serves both dropping repeats and the join.
    once = lists.mapInArrow(pack, "cid bigint, mode int, frames binary").repartition(shuffle_partitions(catalog.sparkSession), "cid").dropDuplicates(["cid"])
    packed = stage_table(once.join(records.select("cid").distinct(), "cid", "left_semi"), "packed")
    return stage_table(records.join(packed.select("cid"), "cid", "left_semi").select("mode", "path", "cid"), "contents"), packed


def butterflies(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, h = rows.shape[1], 1
    m = rows
    while h < n:
        m = m.reshape(len(rows), n // (2 * h), 2, h)
        m = np.stack([m[:, :, 0] + m[:, :, 1], m[:, :, 0] - m[:, :, 1]], axis=2)
        h *= 2
    return m.reshape(len(rows), n) / np.float32(math.sqrt(n))


def pseudo_rotation(rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th pseudo-rotation: three rounds of random signs and Hadamard transform, n log n steps a row."""
    wide = 1 << (rows.shape[1] - 1).bit_length()
    m, rng = np.zeros((len(rows), wide), rows.dtype), np.random.default_rng(1000 + k)
    m[:, : rows.shape[1]] = rows
    for _ in range(3):
        m = butterflies(m * rng.choice([-1.0, 1.0], wide).astype(rows.dtype))
    return m


@lru_cache(maxsize=64)
def rotation(dims: int, k: int) -> np.ndarray:
    return np.ascontiguousarray(pseudo_rotation(np.eye(dims), k), dtype=np.float32)


def rotated(unit: np.ndarray, k: int) -> np.ndarray:
    """At small widths the composed rotation as one matrix product is quicker than its butterflies."""
    return unit @ rotation(unit.shape[1], k) if unit.shape[1] <= DENSE else pseudo_rotation(unit, k)


def nearest_axes(unit: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The probes best signed axes of the k-th rotation, best first, and how much each loses to the best."""
    y = rotated(unit, k)
    size = np.abs(y)
    top = np.empty((len(y), probes), np.int64)
    lost = np.empty((len(y), probes), np.float32)
    row = np.arange(len(y))
    for p in range(probes):
        at = size.argmax(axis=1)
        top[:, p], lost[:, p] = 2 * at + (y[row, at] < 0), size[row, at]
        size[row, at] = -1
    return top, (lost[:, :1] - lost) ** 2


def sketches(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of 64 rotated coordinates: (signs, whether it is large), as 64-bit numbers."""
    wide = 1 << (unit.shape[1] - 1).bit_length()
    y = np.concatenate([rotated(unit, 900 + i) for i in range(-(-SKETCH // wide))], axis=1)[:, :SKETCH] * np.float32(math.sqrt(wide))
    pack = lambda bits: np.packbits(bits, axis=1).view(np.int64).ravel()
    return pack(y > 0), pack(np.abs(y) > LARGE)


def estimate(s: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Row by row, the cosine of two sketches (s, m) and (t, n), all unsigned, whose coordinates read as -3, -1, 1 or 3."""
    ones = lambda bits: np.bitwise_count(bits).astype(np.int16)
    alike = ~(s ^ t)
    dot = lambda mask: 2 * ones(alike & mask) - ones(mask)
    product = 2 * ones(alike) - SKETCH + 2 * (dot(m) + dot(n)) + 4 * dot(m & n)
    return product / np.sqrt((SKETCH + 8.0 * ones(m)) * (SKETCH + 8.0 * ones(n)))


@lru_cache(maxsize=16)
def sketch_bar(least: float, dims: int = DIMS, loss: float = SKETCH_LOSS) -> float:
    """The estimate that all but a share `loss` of the pairs at cosine `least` reach, measured on random pairs."""
    rng, each = np.random.default_rng(4), []
    for _ in range(10):
        a, b = rng.standard_normal((2, 20_000, dims)).astype(np.float32)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1, keepdims=True)
        each.append(estimate(*(x.view(np.uint64) for x in (*sketches(a), *sketches(b)))))
    return float(np.quantile(np.concatenate(each), loss))


def bucket_rows(packed: DataFrame, shape: Shape, tables: range, dims: int = DIMS) -> DataFrame:
    """(place, s, m, cid): every frame of every content in its best `probes` buckets of each of the tables.
    Multiprobe order: least squared loss, summed over the functions, first."""
    bits = (2 * (1 << (dims - 1).bit_length()) - 1).bit_length()
    axes = min(1 << bits, 2 + math.ceil(math.log2(shape.probes)) // 2 + shape.probes // 8)

    def hash_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                unit, counts = stacked(batch.column("frames"), dims)
                unit = unit.astype(np.float32)
                cid, mode = (np.repeat(batch.column(c).to_numpy(), counts).astype(np.int64) for c in ("cid", "mode"))
                s, m = sketches(unit)
                for t in tables:
                    code, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1), np.float32)
                    for f in range(shape.functions):
                        axis, lost = nearest_axes(unit, t * shape.functions + f, axes)
                        code = ((code[:, :, None] << bits) + axis[:, None, :]).reshape(len(unit), -1)
                        loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(unit), -1)
                        if loss.shape[1] > shape.probes:
                            best = np.argpartition(loss, shape.probes - 1, axis=1)[:, : shape.probes]
                            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
                    n = code.shape[1]
                    place = (((t * len(MODES) + mode) << (bits * shape.functions))[:, None] + code).ravel()
                    columns = [place, np.repeat(s, n), np.repeat(m, n), np.repeat(cid, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "s", "m", "cid"])

    return packed.select("cid", "mode", "frames").mapInArrow(hash_frames, "place bigint, s bigint, m bigint, cid bigint")


def mates(place: np.ndarray, s: np.ndarray, m: np.ndarray, cid: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different contents of one place whose sketches look similar; place is sorted. Row i meets row
    i + d for d = 1, 2, ... as long as any place reaches that far."""
    s, m = s.view(np.uint64), m.view(np.uint64)
    low, high, i, d = [], [], np.arange(len(place) - 1), 1
    while len(i):
        i = i[: np.searchsorted(i, len(place) - d)]
        i = i[place[i] == place[i + d]]
        near = estimate(s[i], m[i], s[i + d], m[i + d]) >= bar
        x, y = cid[i[near]], cid[i[near] + d]
        low.append(np.minimum(x, y))
        high.append(np.maximum(x, y))
        d += 1
    if not low:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pairs[0], pairs[1]


def bucket_mates(rows: DataFrame, bar: float, hot: int) -> DataFrame:
    """(a, b, place): pairs of bucket mates with place null; for a bucket of more than `hot` rows, instead of its
    pairs, its members as a, with b null. The rows are shuffled once and compared as they pass in order of place,
    so a task holds one bucket up to `hot` rows, never more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        given_up = -1

        def closed(rows: list[np.ndarray]) -> pa.RecordBatch:
            place = rows[0]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(place)])
            over = np.repeat((sizes > hot) | (place[starts] == given_up), sizes)
            a, b = mates(*[r[~over] for r in rows], bar)
            ids = rows[3][over]
            pair = np.arange(len(a) + len(ids)) < len(a)
            columns = [pa.array(np.r_[a, ids]), pa.array(np.r_[b, ids], mask=~pair), pa.array(np.r_[a, place[over]], mask=pair)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "place"])

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if len(rows[0]) - cut > hot:
                last, cut = rows[0][-1], len(rows[0])
                yield closed(rows)
                given_up = last
            else:
                yield closed([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        yield closed(held)

    return rows.repartition(shuffle_partitions(rows.sparkSession), "place").sortWithinPartitions("place").mapInArrow(compare, "a bigint, b bigint, place bigint").distinct()


def candidate_pairs(packed: DataFrame, current: DataFrame, least: float, keep: int, shape: Shape = Shape(), dims: int = DIMS, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b), a < b: distinct contents that share a bucket and whose sketches look similar; of buckets of more
    than `hot` rows the `keep` most similar mates of each content, measured exactly.

    Buckets that will be hot are foreseen from one content in 16, so that their rows never meet in one task; a
    bucket that turns out hot beyond that is set aside where it is compared. What was foreseen changes only
    where a bucket is measured. Pairs are staged a few tables at a time, which bounds the disk of the shuffles.
    """
    every = range(shape.tables)
    some = bucket_rows(packed.where(F.pmod("cid", F.lit(FORESEEN)) == 0), shape, every, dims)
    large = stage_table(some.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > max(2, hot // FORESEEN)).select("place"), "large")
    foreseen = not large.isEmpty()
    found = None
    for lo in range(0, shape.tables, shape.at_once):
        rows = bucket_rows(packed, shape, range(lo, min(lo + shape.at_once, shape.tables)), dims)
        rows = rows.join(large, "place", "left_anti") if foreseen else rows
        part = stage_table(bucket_mates(rows, sketch_bar(least, dims), hot), "mates")
        found = part if found is None else found.union(part)
    held = found.where(F.col("place").isNotNull()).select(F.col("place").alias("bucket"), F.col("a").alias("cid"))
    if foreseen:
        hot_rows = bucket_rows(packed, shape, every, dims).select("place", "cid").join(large, "place", "left_semi")
        held = held.union(hot_rows.select(F.col("place").alias("bucket"), "cid"))
    pairs = found.where(F.col("place").isNull()).select("a", "b")
    if foreseen or not held.isEmpty():
        pairs = pairs.union(hot_pairs(held.distinct(), current, packed, keep, least, hot, dims))
    return pairs.distinct()


def best_of(left: np.ndarray, right: np.ndarray, cid: np.ndarray, order: np.ndarray, unit: np.ndarray, counts: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, sim): for each content of the left its `keep` most similar of the right,
    ties by order. Products are taken for some left contents at a time."""
    right = right[np.argsort(order[right], kind="stable")]
    starts = np.cumsum(counts) - counts
    rows = lambda some: np.repeat(starts[some] - (np.cumsum(counts[some]) - counts[some]), counts[some]) + np.arange(counts[some].sum())
    others, n = unit[rows(right)].T, counts[right]
    step = np.cumsum(counts[left]) // max(1, 4_000_000 // max(1, others.shape[1]))
    found: list[tuple[np.ndarray, ...]] = [(left[:0], right[:0], np.zeros(0))]
    for part in np.split(left, np.flatnonzero(np.diff(step)) + 1):
        if len(part) and len(right):
            m = counts[part]
            dots = np.maximum.reduceat(unit[rows(part)] @ others, np.cumsum(m) - m, axis=0)
            sims = np.maximum.reduceat(dots, np.cumsum(n) - n, axis=1).round(9)
            sims[cid[part][:, None] == cid[right]] = -2
            if len(right) > keep:
                # All above the keep-th greatest, then those equal to it in their order, until there are `keep`.
                bar = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1 : keep]
                above, level = sims > bar, sims == bar
                chosen = above | (level & (np.cumsum(level, axis=1) <= keep - above.sum(axis=1, keepdims=True)))
            else:
                chosen = np.ones(sims.shape, bool)
            i, j = np.nonzero(chosen & (sims > -2))
            found.append((part[i], right[j], sims[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def in_block_pairs(members: DataFrame, group: str, packed: DataFrame, block: int, dims: int) -> DataFrame:
    """members with their frames, once for each pair (i, j) of blocks of their group that their own block is in.

    A group is dealt into blocks of about `block` frames by hashes, and every two of its blocks meet in one key
    (group, i, j): all pairs of the group can be measured, and no key holds more than two blocks."""
    sized = members.join(packed.select("cid", (F.length("frames") / (2 * dims)).alias("n")), "cid")
    many = sized.groupBy(group).agg(F.ceil(F.sum("n") / block).cast("int").alias("many"))
    own = F.pmod(F.xxhash64("cid"), F.col("many")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    sent = members.join(many, group).withColumn("own", own).join(packed.select("cid", "frames"), "cid").withColumn("at", F.explode(others))
    return sent.select("at.i", "at.j", "own", *members.columns, "frames")


def hot_pairs(held: DataFrame, current: DataFrame, packed: DataFrame, keep: int, least: float, block: int = HOT_BUCKET, dims: int = DIMS) -> DataFrame:
    """(a, b), a < b: for each content in a large bucket its `keep` most similar bucket mates of at least
    `least`, ties by first path. held (bucket, cid), distinct.

    Exact: every two blocks of a bucket meet in one group, in which all pairs are measured. No group holds more
    than two blocks of about `block` frames, and no more than `keep` neighbours of a content leave it.
    """
    named = current.groupBy("cid").agg(F.min("path").alias("first"))
    held = stage_table(held.join(named, "cid"), "hot")
    sent = in_block_pairs(held, "bucket", packed, block, dims)
    schema = "cid bigint, near bigint, sim double, first string"

    def measure(rows: pa.Table) -> pa.Table:
        own, cid, first = rows.column("own").to_numpy(), rows.column("cid").to_numpy(), rows.column("first").to_pylist()
        unit, counts = stacked(rows.column("frames").combine_chunks(), dims)
        order = np.empty(len(first), np.int64)
        order[sorted(range(len(first)), key=first.__getitem__)] = np.arange(len(first))
        left, right = np.flatnonzero(own == rows.column("i")[0].as_py()), np.flatnonzero(own == rows.column("j")[0].as_py())
        ways = [(left, right)] if np.array_equal(left, right) else [(left, right), (right, left)]
        a, b, sim = (np.concatenate(c) for c in zip(*(best_of(x, y, cid, order, unit, counts, keep) for x, y in ways)))
        a, b, sim = (c[sim >= least - 1e-9] for c in (a, b, sim))
        return pa.table({"cid": cid[a], "near": cid[b], "sim": sim, "first": rows.column("first").take(pa.array(b))})

    near = sent.groupBy("bucket", "i", "j").applyInArrow(measure, schema)
    # Partitioned once: repeats from other buckets are dropped and neighbours ranked where the content is.
    each = near.repartition("cid").groupBy("cid", "near").agg(F.max("sim").alias("sim"), F.first("first").alias("first"))
    best = Window.partitionBy("cid").orderBy(F.desc("sim"), "first")
    top = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
    return top.select(F.least("cid", "near").alias("a"), F.greatest("cid", "near").alias("b"))


def verified(pairs: DataFrame, packed: DataFrame, least: float, dims: int = DIMS) -> DataFrame:
    """(a, b, sim) of the pairs whose greatest plain cosine between a frame of each is at least `least`."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = peak_similarity(batch.column("fa"), batch.column("fb"), dims)
            keep = sims >= least
            got = [batch.column(n).filter(pa.array(keep)) for n in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*got, pa.array(sims[keep])], names=["a", "b", "sim"])

    left = pairs.join(packed.select(F.col("cid").alias("a"), F.col("frames").alias("fa")), "a")
    both = left.join(packed.select(F.col("cid").alias("b"), F.col("frames").alias("fb")), "b")
    return both.select("a", "b", "fa", "fb").mapInArrow(measure, "a bigint, b bigint, sim double")


def stacked(column: pa.BinaryArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit frames of all rows, frame counts)."""
    counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // (2 * dims)
    frames = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dims).astype(np.float64)
    return frames / np.linalg.norm(frames, axis=1, keepdims=True), counts


def peak_similarity(left: pa.BinaryArray, right: pa.BinaryArray, dims: int) -> np.ndarray:
    """Row by row, the greatest cosine between a frame of the left and a frame of the right."""
    if not len(left):
        return np.zeros(0)
    (x, m), (y, n) = stacked(left, dims), stacked(right, dims)
    best = np.empty(len(m))
    each = m * n
    cut = np.concatenate([np.searchsorted(np.cumsum(each), np.arange(0, each.sum(), 20_000), side="left"), [len(m)]])
    x0, y0 = np.cumsum(m) - m, np.cumsum(n) - n
    for lo, hi in zip(cut[:-1], cut[1:]):
        if lo == hi:
            continue
        k = each[lo:hi]
        row = np.repeat(np.arange(lo, hi), k)
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        dots = np.einsum("ij,ij->i", x[x0[row] + at // n[row]], y[y0[row] + at % n[row]])
        best[lo:hi] = np.maximum.reduceat(dots, np.cumsum(k) - k)
    return np.minimum(best, 1.0)
