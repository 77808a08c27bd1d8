"""Most similar vectors for every vector, by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm import vectors as V
from lookalike.session import stage_table


def similar_contents(
    current: DataFrame, packed: DataFrame, k: int, least: float, shape: V.Shape = V.Shape(), dims: int = V.DIMS, hot: int = V.HOT_BUCKET
) -> DataFrame:
    """(a, b, sim), a < b: pairs of contents with similarity of at least `least`, among them the k most
    similar bucket mates of each.

    Hash the frames by cross-polytope tables with multiprobe, gather bucket mates, verify exactly. In buckets
    of more than `hot` rows all are measured, and the k most similar of each are kept.
    """
    return V.verified(V.candidate_pairs(packed, current, least, k, shape, dims, hot), packed, least, dims)


def nearest(catalog: DataFrame, k: int = 5, least: float = 0.82, shape: V.Shape = V.Shape(), dims: int = V.DIMS, hot: int = V.HOT_BUCKET) -> DataFrame:
    """(mode, path, other, sim, rank): for each current record its k most similar other records.

    Similarity is the greatest plain cosine between a frame of one and a frame of the other, within a
    mode; only records with at least `least` are listed, ties by path. A record whose list is null or
    empty, or holds a frame of another width, a non-finite value or only zeros, takes no part; an empty
    catalog gives no rows; columns beyond mode, path, last_scan, vector and faces are not read.

    Equal contents are searched once. A group of copies lists its first members by path: each copy gets
    the k smallest paths of its group before any other content, so no group is paired with itself.
    """
    current, packed = V.contents(catalog, dims)
    found = stage_table(similar_contents(current, packed, k, least, shape, dims, hot), "similar")
    return expand(current, found, k)


def expand(current: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Lists of records from pairs of contents."""
    by_path = Window.partitionBy("cid").orderBy("path")
    few = current.withColumn("n", F.row_number().over(by_path)).where(F.col("n") <= k + 1).select("cid", "path")
    ways = found.select("a", "b", "sim").union(found.select("b", "a", "sim")).toDF("cid", "near", "sim")
    others = ways.join(few.select(F.col("cid").alias("near"), F.col("path").alias("other")), "near").select("cid", "other", "sim")
    copies = few.withColumn("n", F.count("*").over(Window.partitionBy("cid"))).where(F.col("n") > 1)
    own = copies.select("cid", F.col("path").alias("other"), F.lit(1.0).alias("sim"))
    best = Window.partitionBy("cid").orderBy(F.desc("sim"), "other")
    top = others.union(own).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "other", "sim"))).alias("top"))
    mine = F.slice(F.filter("top", lambda x: x["other"] != F.col("path")), 1, k)
    each = current.join(lists, "cid").select("mode", "path", F.posexplode(mine).alias("rank", "x"))
    return each.select("mode", "path", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"), (F.col("rank") + 1).alias("rank"))


def found(catalog: DataFrame) -> DataFrame:
    """(mode, path_a, path_b), path_a < path_b: pairs of which at least one lists the other."""
    each = nearest(catalog)
    return each.select("mode", F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b")).distinct()


def brute_force(packed: DataFrame, queries: DataFrame, least: float, block: int = 2000, dims: int = V.DIMS) -> DataFrame:
    """(q, cid, sim): every content at least `least` similar to a query content, by measuring all.

    The stated query set passes over the driver in blocks of bounded size; each block is held against all
    contents in one scan. Both frames have (cid, frames); contents of other modes are told apart by name.
    """
    spark, found = packed.sparkSession, None
    rows = queries.select("cid", "frames").toLocalIterator()
    while held := [r for _, r in zip(range(block), rows)]:
        sent = spark.sparkContext.broadcast([(r.cid, bytes(r.frames)) for r in held])

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids = np.array([c for c, _ in sent.value])
            frames, counts = V.stacked(pa.array([f for _, f in sent.value], pa.binary()), dims)
            starts = np.cumsum(counts) - counts
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    others, n = V.stacked(part.column("frames"), dims)
                    if len(others):
                        dots = np.maximum.reduceat(frames @ others.T, starts, axis=0)
                        sims = np.maximum.reduceat(dots, np.cumsum(n) - n, axis=1)
                        i, j = np.nonzero(sims >= least)
                        cid = part.column("cid").to_numpy()[j]
                        keep = ids[i] != cid
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(cid[keep]), pa.array(sims[i, j][keep])], names=["q", "cid", "sim"])

        part = packed.select("cid", "frames").mapInArrow(scan, "q bigint, cid bigint, sim double")
        found = part if found is None else found.union(part)
    return found if found is not None else packed.select(F.col("cid").alias("q"), "cid", F.lit(0.0).alias("sim")).limit(0)


def recall(catalog: DataFrame, k: int = 5, least: float = 0.82, every: int = 50, shape: V.Shape = V.Shape(), hot: int = V.HOT_BUCKET) -> DataFrame:
    """(mode, queries, true, listed, recall): of the k most similar contents of every content whose id is
    divisible by `every`, the share that the index finds, against brute force over all contents."""
    current, packed = V.contents(catalog)
    best = Window.partitionBy("q").orderBy(F.round("sim", 6).desc(), "cid")
    top = lambda rows: rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    found = stage_table(similar_contents(current, packed, k, least, shape, hot=hot), "similar")
    ways = found.select("a", "b", "sim").union(found.select("b", "a", "sim")).toDF("q", "cid", "sim").where(F.pmod("q", F.lit(every)) == 0)
    mine = top(ways).select("q", "cid", F.lit(1).alias("hit"))
    modes = []
    for number, mode in enumerate(V.MODES):
        own = packed.where(F.col("mode") == number)
        modes.append(brute_force(own, own.where(F.pmod("cid", F.lit(every)) == 0), least).withColumn("mode", F.lit(mode)))
    want = top(modes[0].union(modes[1]))
    return want.join(mine, ["q", "cid"], "left").groupBy("mode").agg(
        F.countDistinct("q").alias("queries"), F.count("*").alias("true"), F.count("hit").alias("listed"), F.round(F.count("hit") / F.count("*"), 4).alias("recall")
    )
