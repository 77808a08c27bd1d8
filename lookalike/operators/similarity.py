"""The vector similarity self-join: centring, neighbours, pair verification, acceptance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.media import bars
from lookalike.operators.pieces import by_pieces, unit_rows
from lookalike.session import stage_table

SAME_FRAME, LEAST_COVERAGE, COVERAGE_COST = 0.55, 0.30, 0.25
STRUCTURAL_BITS, CLOSE_BITS, STRUCTURAL_BONUS, CLOSE_BONUS = 4, 6, 0.18, 0.05
#: Frames of one block of the exact join.
BLOCK = 8192
NEIGHBOURS = 256
#: Of the join by cells: frames for each centre, centres at most, visits of a frame.
IN_CELL, MOST_CELLS, PROBES = 250, 4096, 24


def usable(vectors: str = "vector", dims: int | None = None) -> Column:
    """A frame list, of the given width if any, without nulls, non-finite values and zero frames."""
    good = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    wide = (lambda v: (F.size(v) == dims) & good(v)) if dims else good
    return F.coalesce((F.size(vectors) > 0) & F.forall(vectors, wide), F.lit(False))


def frames(items: DataFrame, vectors: str = "vector", dims: int | None = None) -> DataFrame:
    """(path, frame, vec) of items whose frames are all usable."""
    return items.where(usable(vectors, dims)).select("path", F.posexplode(vectors).alias("frame", "vec"))


def mean_vector(frames: DataFrame) -> list[float]:
    """Mean over frames, dimension by dimension: as many numbers as a vector has; none if there is no frame."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    mean = frames.select(array_to_vector("vec").alias("v")).groupBy(F.lit(True)).agg(Summarizer.mean(F.col("v")).alias("m")).first()
    return [] if mean is None else mean.m.toArray().tolist()


def centred(frames: DataFrame, mean: list[float] | None = None) -> DataFrame:
    """Frames minus the mean, at unit length; a frame equal to the mean stays zero. In the JVM throughout."""
    mean = mean_vector(frames) if mean is None else mean
    less = F.zip_with(F.col("vec"), F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m)
    norm = F.sqrt(F.aggregate(less, F.lit(0.0), lambda s, x: s + x * x))
    return frames.withColumn("vec", F.transform(less, lambda x: x / F.when(norm > 0, norm).otherwise(1.0)))


def in_blocks(frames: DataFrame, block: int) -> DataFrame:
    """(i, j, own, path, frame, vec): every frame, once for each pair of hashed blocks that its own is in.

    Each pair of blocks is one group: a frame is sent to as many groups as there are blocks, and no task
    holds more than two blocks.
    """
    many = max(1, -(-frames.count() // block))
    own = F.pmod(F.xxhash64("path", "frame"), F.lit(many)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    sent = frames.withColumn("own", own).withColumn("at", F.explode(others))
    return sent.select("at.i", "at.j", "own", "path", "frame", "vec")


def unit_vectors(column: pa.ListArray, mean: list[float] | None) -> np.ndarray:
    """The vectors of a column as doubles: as they are without a mean; else less the mean, at unit length, as `centred`."""
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1), mean)


def two_blocks(rows: pa.Table, mean: list[float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(vectors, rows of the one block, rows of the other, order of each row's path, paths, frame numbers)."""
    own = rows.column("own").to_numpy()
    left, right = np.flatnonzero(own == rows.column("i")[0].as_py()), np.flatnonzero(own == rows.column("j")[0].as_py())
    vectors = unit_vectors(rows.column("vec").combine_chunks(), mean)
    path = rows.column("path").combine_chunks()
    coded = path.dictionary_encode()
    order = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object), kind="stable"))
    return vectors, left, right, order[coded.indices.to_numpy()], path, rows.column("frame").to_numpy()


def block_pairs(frames: DataFrame, least: float, block: int = BLOCK, mean: list[float] | None = None) -> DataFrame:
    """(a, fa, b, fb, cos), a < b: frame pairs of different paths with a cosine of at least `least`.

    Exact: every two blocks meet in one group, and products are taken a slice of a block at a time. With a mean,
    vectors travel as they are and are centred where they are multiplied; without, they have unit length.
    """

    def products(rows: pa.Table) -> pa.Table:
        vectors, left, right, order, path, frame = two_blocks(rows, mean)
        found: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(left), 1024):
            part = left[lo : lo + 1024]
            dots = vectors[part] @ vectors[right].T
            p, q = np.nonzero(dots >= least)
            cos, p, q = dots[p, q], part[p], right[q]
            keep = order[p] < order[q] if np.array_equal(left, right) else order[p] != order[q]
            cos, p, q = cos[keep], p[keep], q[keep]
            swap = order[p] > order[q]
            found.append((np.where(swap, q, p), np.where(swap, p, q), cos))
        a, b, cos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": path.take(pa.array(a)), "fa": pa.array(frame[a]), "b": path.take(pa.array(b)), "fb": pa.array(frame[b]), "cos": pa.array(cos)})

    return in_blocks(frames, block).groupBy("i", "j").applyInArrow(products, "a string, fa int, b string, fb int, cos double")


def nearest_frames(frames: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(path, frame, other, other_frame, cos, rank): the k nearest frames of other paths, ties by name.

    Each two blocks keep k of each frame's neighbours, with those as near as the k-th; then the best of all
    blocks are taken. So a frame passes on about k rows per block, not one per frame.
    """

    def best_of(rows: pa.Table) -> pa.Table:
        vectors, left, right, order, path, frame = two_blocks(rows, None)
        sides = [(left, right)] if np.array_equal(left, right) else [(left, right), (right, left)]
        found: list[tuple[np.ndarray, ...]] = []
        for one, other in sides:
            for lo in range(0, len(one) if len(other) else 0, 1024):
                part = one[lo : lo + 1024]
                dots = vectors[part] @ vectors[other].T
                dots[order[part][:, None] == order[other][None, :]] = -np.inf
                least = np.partition(dots, -k, axis=1)[:, -k] if k < dots.shape[1] else np.full(len(part), -2.0)
                p, q = np.nonzero(dots >= np.maximum(least, -2.0)[:, None] - 1e-9)
                found.append((part[p], other[q], dots[p, q]))
        a, b, cos = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"path": path.take(pa.array(a)), "frame": pa.array(frame[a]), "other": path.take(pa.array(b)), "other_frame": pa.array(frame[b]), "cos": pa.array(cos)})

    ways = in_blocks(frames, block).groupBy("i", "j").applyInArrow(best_of, "path string, frame int, other string, other_frame int, cos double")
    best = Window.partitionBy("path", "frame").orderBy(F.round("cos", 9).desc(), "other", "other_frame")
    return ways.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_frames_hashed(frames: DataFrame, radius: float, bucket: float = 0.6, tables: int = 6) -> DataFrame:
    """(a, fa, b, fb, cos), a < b: as block_pairs, for frame counts beyond the exact join: random
    projection hashing finds the candidates, their distance is then measured; some pairs are missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = frames.select("path", "frame", array_to_vector("vec").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, radius, "distance").where(F.col("datasetA.path") < F.col("datasetB.path"))
    cos = 1 - F.col("distance") * F.col("distance") / 2
    return near.select(F.col("datasetA.path").alias("a"), F.col("datasetA.frame").alias("fa"), F.col("datasetB.path").alias("b"), F.col("datasetB.frame").alias("fb"), cos.alias("cos"))


def cell_pairs(frames: DataFrame, least: float, cells: int | None = None, probes: int = PROBES, block: int = BLOCK, mean: list[float] | None = None) -> DataFrame:
    """(a, fa, b, fb, cos), a < b: as block_pairs, faster; some pairs are missed, the more the more cells there are. No query goes by it.

    Some frames, 4,096 at most, are centres. A frame lives in the cell of its nearest centre and visits those of its
    `probes` nearest; the visitors of a cell are held against those who live there. Inhabitants of a large cell
    are dealt into blocks, each of which all visitors see, so no task holds more than a block of them; a frame is
    sent out `probes` times, however many frames there are. frames: path, frame, vec, on disk.
    """
    cells = cells or min(MOST_CELLS, frames.count() // IN_CELL + 1)
    centres = frames.orderBy(F.xxhash64("path", "frame")).limit(cells).select("vec").toArrow().column("vec").combine_chunks()
    if not len(centres):
        return frames.select(F.col("path").alias("a"), F.col("frame").alias("fa"), F.col("path").alias("b"), F.col("frame").alias("fb"), F.lit(0.0).alias("cos")).limit(0)
    points = unit_vectors(centres, mean).astype(np.float32)

    def visit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                dots = unit_vectors(part.column("vec"), mean).astype(np.float32) @ points.T
                k = min(probes, len(points))
                near = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                home = near[np.arange(len(near)), np.take_along_axis(dots, near, 1).argmax(axis=1)]
                rows = np.repeat(np.arange(part.num_rows), k)
                cell = near.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(cell == home[rows]), *(part.column(c).take(pa.array(rows)) for c in ("path", "frame", "vec"))], names=["cell", "lives", "path", "frame", "vec"]
                )

    rows = frames.select("path", F.col("frame").cast("int").alias("frame"), "vec")
    visits = rows.mapInArrow(visit, f"cell int, lives boolean, path string, frame int, vec {frames.schema['vec'].dataType.simpleString()}")
    counts = visits.where("lives").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("many"))
    visits = visits.join(counts, "cell")
    own = F.pmod(F.xxhash64("path", "frame"), F.col("many")).cast("int")
    inside = visits.where("lives").select("cell", own.alias("block"), "lives", "path", "frame", "vec")
    callers = visits.select("cell", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), F.lit(False).alias("lives"), "path", "frame", "vec")

    def products(rows: pa.Table) -> pa.Table:
        lives = rows.column("lives").to_numpy(zero_copy_only=False)
        vectors = unit_vectors(rows.column("vec").combine_chunks(), mean)
        path, frame = rows.column("path").combine_chunks(), rows.column("frame").to_numpy()
        names = np.array(path.to_pylist(), dtype=object)
        here, found = np.flatnonzero(lives), [np.zeros((3, 0))]
        callers = np.flatnonzero(~lives)
        for lo in range(0, len(callers), 1024):
            part = callers[lo : lo + 1024]
            dots = vectors[part] @ vectors[here].T
            p, q = np.nonzero(dots >= least)
            found.append(np.stack([part[p], here[q], dots[p, q]]))
        p, q, cos = np.concatenate(found, axis=1)
        p, q = p.astype(np.int64), q.astype(np.int64)
        keep = names[p] != names[q]
        p, q, cos = p[keep], q[keep], cos[keep]
        swap = (names[p] > names[q]).astype(bool)
        a, b = np.where(swap, q, p), np.where(swap, p, q)
        return pa.table({"a": path.take(pa.array(a)), "fa": pa.array(frame[a]), "b": path.take(pa.array(b)), "fb": pa.array(frame[b]), "cos": pa.array(cos)})

    pairs = inside.union(callers).groupBy("cell", "block").applyInArrow(products, "a string, fa int, b string, fb int, cos double")
    return pairs.groupBy("a", "fa", "b", "fb").agg(F.max("cos").alias("cos"))


def candidates(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").distinct()


def accepted(pairs: DataFrame, slider: float, mode: str = "visual") -> DataFrame:
    """(a, b, sim) of the verified pairs that become edges; pairs has bits, the frame distance, in visual mode."""
    bar, _ = bars(slider, mode)
    sim = F.col("sim")
    if mode == "faces":
        return pairs.where(sim >= bar).select("a", "b", "sim")
    structural = F.coalesce(F.col("bits") <= STRUCTURAL_BITS, F.lit(False))
    close = F.coalesce(F.col("bits") <= CLOSE_BITS, F.lit(False))
    take = (
        F.when(F.col("multi") & ~structural & (F.col("coverage") < LEAST_COVERAGE), False)
        .when(sim >= bar, True)
        .when(structural, sim >= bar - STRUCTURAL_BONUS)
        .when(close, sim >= bar - CLOSE_BONUS)
        .otherwise(False)
    )
    return pairs.where(take).select("a", "b", "sim")


def verified(items: DataFrame, slider: float, mode: str = "visual", vectors: str = "vector", dims: int | None = None, reach: tuple[float, float, int] | None = None) -> DataFrame:
    """(a, b, peak, coverage, multi, sim, bits) of all pairs of items that pass the prefilter, however many there are; items:
    a row a path. Usable items are staged once; pairs are found by tasks that read them (`by_pieces`). With a reach,
    of those within it, and bits is the distance of their hashes."""
    columns = ["path", F.col(vectors).alias("vector")] + ["dhash"] * bool(reach)
    held = stage_table(items.where(usable(vectors, dims)).select(*columns), "frames")
    mean = mean_vector(held.select(F.explode("vector").alias("vec")))
    _, prefilter = bars(slider, mode)
    gated = mode == "visual"
    return by_pieces(held, min(prefilter, SAME_FRAME) if gated else prefilter, prefilter, SAME_FRAME, COVERAGE_COST, gated, mean, reach)


def edges(items: DataFrame, slider: float, mode: str = "visual", vectors: str = "vector", dims: int | None = None) -> DataFrame:
    """(a, b, sim): the similarity graph of items (path, vector, dhash)."""
    bar, _ = bars(slider, mode)
    reach = (bar - CLOSE_BONUS, bar - STRUCTURAL_BONUS, STRUCTURAL_BITS) if mode == "visual" else None
    return accepted(verified(items, slider, mode, vectors, dims, reach), slider, mode)
