"""Leader clustering in rounds, and what is said of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.paths import suffix
from lookalike.operators.numbering import numbered as dense
from lookalike.session import stage_table


def leaders(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leader, path, similarity): clusters of two or more; edges (a, b, sim), sizes (path, size).

    In order of size, largest first and ties by path, a file not yet taken leads and takes its direct
    neighbours. The same result in rounds: every undecided file without an undecided larger neighbour
    leads, its neighbours are members, and both leave. Files of one round decide independently. Each
    round is a few joins and a staged table; nothing is gathered on the driver.
    """
    ranked = sizes.groupBy("path").agg(F.max("size").alias("size")).select("path", (-F.coalesce("size", F.lit(0))).alias("rank"))
    both = F.array(F.struct(F.col("a").alias("path"), F.col("b").alias("other"), "sim"), F.struct(F.col("b").alias("path"), F.col("a").alias("other"), "sim"))
    ways = edges.select(F.explode(both).alias("way")).select("way.*").where(F.col("path") != F.col("other"))  # edges are made once, not for each side
    # Ways are shuffled once by each end: by path they are ranked and combined, by other ranked again. The first is asked for:
    # before it Spark can't know how many they are, and would broadcast them all.
    ways = ways.repartition("path").join(ranked.toDF("path", "mine"), "path").groupBy("path", "other", "mine").agg(F.max("sim").alias("sim"))
    ways = ways.join(ranked.toDF("other", "rank"), "other")
    ways = stage_table(ways.select("path", "other", "sim", "rank", (F.struct("rank", "other") < F.struct("mine", "path")).alias("up")), "ways")
    left, chosen = ways.select("path", "other", "up"), None
    while True:
        # Of each undecided file: whether it leads in this round, and whether it or a neighbour does.
        tops = left.groupBy("path").agg((~F.max("up")).alias("top"))
        met = left.join(tops.toDF("other", "by"), "other").groupBy("path").agg((~F.max("up")).alias("top"), F.max("by").alias("by"))
        state = stage_table(met.select("path", "top", (F.col("top") | F.col("by")).alias("taken")), "state")
        free = state.where(~F.col("taken")).select("path")
        rest = stage_table(left.join(free, "path", "left_semi").join(free.toDF("other"), "other", "left_semi").select("path", "other", "up"), "left")
        # A file all of whose neighbours have been taken leads too, and neighbours that rank it first are its own.
        alone = free.join(rest.select("path").distinct(), "path", "left_anti")
        leading = state.where("top").select("path").union(alone)
        chosen = leading if chosen is None else chosen.union(leading)
        if rest.isEmpty():
            break
        left = rest
    heads = stage_table(chosen, "leaders")
    below = ways.join(heads.toDF("other"), "other").join(heads, "path", "left_anti")
    own = below.groupBy("path").agg(F.min_by(F.struct("other", "sim"), F.struct("rank", "other")).alias("best")).select(F.col("best.other").alias("leader"), "path", F.col("best.sim").alias("similarity"))
    own = stage_table(own, "members")  # ways are gone through once for members and leaders
    led = own.select("leader").distinct().select("leader", F.col("leader").alias("path"), F.lit(1.0).alias("similarity"))
    return own.union(led)


def numbered(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds cluster_id, 1 for the largest leader, and pos, the rank within the cluster: the leader, then by similarity.

    Numbers are dense over all clusters; they are given by ranges, so no task orders them all.
    """
    heads = clusters.select("leader").distinct().join(sizes.toDF("leader", "size"), "leader", "left")
    heads = dense(heads, "cluster_id", F.coalesce("size", F.lit(0)).desc(), "leader").select("leader", "cluster_id")
    within = Window.partitionBy("leader").orderBy((F.col("path") == F.col("leader")).desc(), F.col("similarity").desc(), "path")
    return clusters.join(heads, "leader").withColumn("pos", F.row_number().over(within))


def summary(members: DataFrame) -> DataFrame:
    """(cluster_id, files, bytes, formats, similarity) of members (cluster_id, path, size, similarity)."""
    formats = F.array_join(F.array_sort(F.collect_set(F.when(suffix() != "", F.upper(suffix())))), ", ")
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), formats.alias("formats"), F.avg("similarity").alias("similarity")
    )


def pruned(members: DataFrame, gone: DataFrame) -> DataFrame:
    """(cluster_id, path, size, files, bytes) after the paths in gone left; clusters of one are dropped."""
    rest = members.join(gone.select("path").distinct(), "path", "left_anti")
    now = rest.groupBy("cluster_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes")).where(F.col("files") > 1)
    return rest.join(now, "cluster_id").select("cluster_id", "path", "size", "files", "bytes")
