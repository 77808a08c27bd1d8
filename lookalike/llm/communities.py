"""Clusters of mutually similar records: a neighbour graph by descent, communities by modularity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm import vectors as V
from lookalike.session import shuffle_partitions, stage_table

LEAST = 0.82
#: Neighbours by which a node introduces others to each other in a round of descent.
LIST = 24
#: The hash tables from which the lists start.
START = V.Shape(tables=3, at_once=1)
#: Descent ends with the round that adds less than this share of the edges.
SETTLED = 0.002
#: Moving ends with a round that raises modularity by no more.
RISE = 1e-9
#: Frames of a community, or of a block of a larger one, that are measured at once.
BLOCK = 2000


def both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "sim").union(edges.select("b", "a", "sim")).toDF("u", "v", "sim")


def neighbour_graph(current: DataFrame, packed: DataFrame, least: float = LEAST, dims: int = V.DIMS, settled: float = SETTLED, width: int = LIST) -> DataFrame:
    """(a, b, sim), staged: edges between contents at least `least` similar, found by neighbour descent.

    The lists start from bucket mates of a few hash tables instead of random nodes, which saves rounds. In each
    round every node introduces its nearest neighbours to each other, if one of the two edges is new; similar
    ones become edges. Rounds go on until one adds less than a share `settled` of the edges. The list is
    bounded, so a node of any degree makes a bounded number of introductions; what bounded lists miss inside
    a community is made up for where communities are measured.
    """
    found = V.verified(V.candidate_pairs(packed, current, least, width, START, dims), packed, least, dims)
    edges = stage_table(found.withColumn("new", F.lit(True)), "edges")
    count = edges.count()
    while count:
        ways = edges.select("a", "b", "sim", "new").union(edges.select("b", "a", "sim", "new")).toDF("v", "u", "sim", "new")
        lists = ways.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("n") <= width)
        one, two = lists.select("v", F.col("u").alias("a"), "new"), lists.select("v", F.col("u").alias("b"), F.col("new").alias("other"))
        met = one.join(two, "v").where((F.col("a") < F.col("b")) & (F.col("new") | F.col("other"))).select("a", "b", F.lit(False).alias("known"))
        # Known edges and repeats go in one combining aggregation.
        unknown = met.union(edges.select("a", "b", F.lit(True))).groupBy("a", "b").agg(F.max("known").alias("known")).where(~F.col("known"))
        fresh = V.verified(unknown.select("a", "b"), packed, least, dims)
        fresh = stage_table(fresh.select("a", "b", "sim", F.lit(True).alias("new")), "edges")
        added = fresh.count()
        count += added
        edges = fresh.union(edges.select("a", "b", "sim", F.lit(False).alias("new")))
        if added <= settled * count:
            break
    return edges.select("a", "b", "sim")


def stepped(ways: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """(u, c, k, own, outer, want), staged: of each node with label c and strength k, the weight to its own
    community, whether an edge leaves it, and the neighbouring community that would raise modularity most, or its
    own. ways (u, v, w) holds both directions and self loops; labels (u, c, k)."""
    ends = labels.select(F.col("u").alias("v"), F.col("c").alias("to"))
    sizes = labels.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("size"))
    free = F.when(F.col("u") != F.col("v"), F.col("w")).otherwise(0.0)
    touching = ways.join(ends, "v").select("u", "to", "w", free.alias("free"))
    stay = labels.select("u", F.col("c").alias("to"), F.lit(0.0).alias("w"), F.lit(0.0).alias("free"))
    options = touching.union(stay).groupBy("u", "to").agg(F.sum("w").alias("w"), F.sum("free").alias("free")).join(labels, "u").join(sizes, "to")
    here = F.col("to") == F.col("c")
    gain = F.round(F.col("free") - F.col("k") * (F.col("size") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
    each = options.groupBy("u", "c", "k").agg(
        F.max(F.when(here, F.col("w"))).alias("own"), F.max(~here).alias("outer"), F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best"), F.max(F.when(here, gain)).alias("gain")
    )
    want = F.when(F.col("best.gain") > F.col("gain") + 1e-9, -F.col("best.to")).otherwise(F.col("c"))
    return stage_table(each.select("u", "c", "k", "own", "outer", want.alias("want")), "step")


def standing(step: DataFrame, total: float) -> tuple[float, int, int]:
    """(modularity of the labels that the step began with, nodes that want a smaller name, a larger one)."""
    down, up = F.sum((F.col("want") < F.col("c")).cast("int")), F.sum((F.col("want") > F.col("c")).cast("int"))
    sizes = step.groupBy("c").agg(F.sum("own").alias("own"), F.sum("k").alias("k"), down.alias("down"), up.alias("up"))
    row = sizes.agg(F.sum(F.col("own") / total - F.col("k") * F.col("k") / (total * total)), F.sum("down"), F.sum("up")).first()
    return row[0] or 0.0, row[1] or 0, row[2] or 0


def local_moving(ways: DataFrame, labels: DataFrame, total: float) -> tuple[DataFrame, bool]:
    """((u, c), whether any moved): rounds of moves until no node wants to move or modularity no longer rises.

    In one round nodes move to smaller names only, in the next to larger ones, so that two never swap."""
    step = stepped(ways, labels, total)
    now, down, up = standing(step, total)
    start, smaller = now, True
    while down or up:
        smaller = bool(down) if smaller else not up
        goes = (F.col("want") < F.col("c")) == F.lit(smaller)
        after = stepped(ways, step.select("u", F.when(goes, F.col("want")).otherwise(F.col("c")).alias("c"), "k"), total)
        then, down, up = standing(after, total)
        if then <= now + RISE:
            break
        step, now, smaller = after, then, not smaller
    return step.select("u", "c"), now > start


def communities(edges: DataFrame) -> DataFrame:
    """(cid, community): nodes of the weighted edges by community, found by moving nodes and then whole
    communities, level by level, as long as modularity rises. Every node starts with the smallest node around it.

    A community that no edge leaves is final: nobody in it gains by going, and nobody else has an edge to it. So
    after one turn over the whole graph only the others go on.
    """
    ways = stage_table(both(edges).select("u", "v", F.col("sim").alias("w")), "ways")
    total = ways.agg(F.sum("w")).first()[0] or 1.0
    start = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("c"), F.sum("w").alias("k"))
    step = stepped(ways, start, total)
    leaving = step.groupBy("c").agg(F.max("outer").alias("outer")).where("outer").select("c")
    final = step.join(leaving, "c", "left_anti").select("u", "c")
    labels = stage_table(step.join(leaving, "c", "left_semi").select("u", "c", "k"), "labels")
    ways = stage_table(ways.join(labels.select("u"), "u", "left_semi"), "ways")
    if labels.isEmpty():
        return final.toDF("cid", "community")
    placed, _ = local_moving(ways, labels, total)
    while True:
        ends = placed.select(F.col("u").alias("v"), F.col("c").alias("d"))
        merged = ways.join(placed, "u").join(ends, "v").groupBy(F.col("c").alias("u"), F.col("d").alias("v")).agg(F.sum("w").alias("w"))
        merged = stage_table(merged, "merged")
        higher, moved = local_moving(merged, merged.groupBy("u").agg(F.first("u").alias("c"), F.sum("w").alias("k")), total)
        if not moved:
            return final.union(placed).toDF("cid", "community")
        placed = stage_table(placed.join(higher.toDF("c", "above"), "c").select("u", F.col("above").alias("c")), "labels")


def clustered(catalog: DataFrame, least: float, dims: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, packed, edges, members): members (cid, community, copies, first) of all contents with
    a neighbour or with copies; a content without a neighbour is its own community."""
    current, packed = V.contents(catalog, dims)
    edges = neighbour_graph(current, packed, least, dims)
    groups = current.groupBy("cid").agg(F.count("*").alias("copies"), F.min("path").alias("first"))
    placed = groups.join(communities(edges), "cid", "left").where(F.col("community").isNotNull() | (F.col("copies") > 1))
    members = placed.select("cid", F.coalesce("community", "cid").alias("community"), "copies", "first")
    return current, packed, edges, stage_table(members, "members")


def measured(members: DataFrame, packed: DataFrame, dims: int = V.DIMS, block: int = BLOCK) -> DataFrame:
    """(community, cid, sum, least): of each member, the summed similarity to the other contents of its community,
    each counted with its copies, and the least one (2 without others).

    Exact: all pairs of a community are measured, in blocks of which every two meet under one key. Keys pass in
    order through numpy, so small communities share a task and a large one is spread over many; no pair is a row.
    """
    sent = V.in_block_pairs(members.select("cid", "community", "copies"), "community", packed, block, dims)
    keys = ["community", "i", "j"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed(rows: pa.Table) -> pa.RecordBatch:
            key = np.stack([rows.column(k).to_numpy() for k in keys]).astype(np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]), key.shape[1]]
            own, copies = rows.column("own").to_numpy(), rows.column("copies").to_numpy().astype(np.float64)
            unit, counts = V.stacked(rows.column("frames").combine_chunks(), dims)
            first = np.cumsum(counts) - counts
            total, least = np.zeros(len(own)), np.full(len(own), 2.0)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                i, j = key[1, lo], key[2, lo]
                here = slice(first[lo], first[hi - 1] + counts[hi - 1])
                starts = first[lo:hi] - first[lo]
                frames = unit[here]
                for some in np.split(np.arange(hi - lo), np.arange(512, hi - lo, 512)):
                    rows_ = np.concatenate([np.arange(starts[x], starts[x] + counts[lo + x]) for x in some])
                    dots = np.maximum.reduceat(frames[rows_] @ frames.T, np.r_[0, np.cumsum(counts[lo + some])[:-1]], axis=0)
                    sims = np.minimum(np.maximum.reduceat(dots, starts, axis=1), 1.0)
                    # Of two blocks only pairs across are counted here, of one block all but a content with itself.
                    skip = some[:, None] == np.arange(hi - lo) if i == j else own[lo + some][:, None] == own[lo:hi]
                    total[lo + some] = np.where(skip, 0.0, sims) @ copies[lo:hi]
                    least[lo + some] = np.where(skip, 2.0, sims).min(axis=1)
            columns = [rows.column("community").combine_chunks(), rows.column("cid").combine_chunks(), pa.array(total), pa.array(least)]
            return pa.RecordBatch.from_arrays(columns, names=["community", "cid", "sum", "least"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows = pa.Table.from_batches(held)
                key = [rows.column(k).to_numpy() for k in keys]
                same = np.logical_and.reduce([k == k[-1] for k in key])
                cut = int(np.argmax(same))
                if cut:
                    yield closed(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield closed(pa.Table.from_batches(held))

    in_order = sent.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    each = in_order.mapInArrow(measure, "community bigint, cid bigint, sum double, least double")
    return each.groupBy("community", "cid").agg(F.sum("sum").alias("sum"), F.min("least").alias("least"))


def found(catalog: DataFrame, least: float = LEAST, dims: int = V.DIMS, block: int = BLOCK) -> DataFrame:
    """(mode, path, typical_path): members of the clusters of 3 or more records in which every two are at
    least `least` similar and none is to a record outside.

    Communities come from modularity on the whole neighbour graph; then they are checked exactly. One with an edge
    to another is none; of any other all pairs are measured, also those that the graph lacks. Edges to records
    outside are only those that the graph has. Equal contents count with their copies, at similarity 1.
    typical_path has the greatest mean similarity to the other members, ties by path. Records that take no part,
    empty tables and extra columns are treated as in `neighbours.nearest`.
    """
    current, packed, edges, members = clustered(catalog, least, dims)
    home = members.select("cid", "community")
    ends = edges.join(home.toDF("a", "ca"), "a").join(home.toDF("b", "cb"), "b").where(F.col("ca") != F.col("cb"))
    leaking = ends.select("ca").union(ends.select("cb")).toDF("community").distinct()
    sizes = members.groupBy("community").agg(F.sum("copies").alias("records")).where(F.col("records") >= 3)
    whole = stage_table(members.join(sizes, "community").join(leaking, "community", "left_anti"), "whole")
    sums = stage_table(measured(whole, packed, dims, block), "measured")
    unlike = sums.where(F.col("least") < least).select("community").distinct()
    good = whole.join(sums.select("cid", "sum"), "cid").join(unlike, "community", "left_anti")
    return with_typical(current, good).select("mode", "path", "typical_path")


def with_typical(current: DataFrame, members: DataFrame) -> DataFrame:
    """(mode, path, community, records, typical_path) of the records of members (cid, community, copies, first,
    records, sum): the member of highest internal weighted degree, its own copies counted, is typical."""
    score = F.round(F.coalesce("sum", F.lit(0.0)) + F.col("copies") - 1, 9)
    best = members.groupBy("community").agg(F.min_by("first", F.struct(-score, "first")).alias("typical_path"))
    placed = members.join(best, "community").select("cid", "community", "records", "typical_path")
    return current.join(placed, "cid").select("mode", "path", "community", "records", "typical_path")


def described(catalog: DataFrame, least: float = LEAST, dims: int = V.DIMS) -> DataFrame:
    """(mode, path, records, typical_path): every record with a neighbour or a copy, the size of its
    community and the member of highest internal weighted degree in the neighbour graph."""
    current, _, edges, members = clustered(catalog, least, dims)
    ways = both(edges).join(members.select(F.col("cid").alias("u"), F.col("community").alias("c")), "u")
    ways = ways.join(members.select(F.col("cid").alias("v"), F.col("community").alias("d"), "copies"), "v").where(F.col("c") == F.col("d"))
    sums = ways.groupBy(F.col("u").alias("cid")).agg(F.sum(F.col("sim") * F.col("copies")).alias("sum"))
    sizes = members.groupBy("community").agg(F.sum("copies").alias("records"))
    placed = with_typical(current, members.join(sizes, "community").join(sums, "cid", "left"))
    return placed.select("mode", "path", "records", "typical_path")
