"""Views of a result: filters, sorting, statistics, selections and plans of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.media import area
from lookalike.functions.paths import basename, kind, matches_text, parent, shown_as, suffix
from lookalike.operators.numbering import numbered

SORTS = {
    "path": lambda: F.col("path"),
    "suffix": lambda: suffix(),
    "similarity": lambda: F.col("similarity"),
    "size": lambda: F.coalesce("size", F.lit(0)),
    "resolution": lambda: area(),
    "mtime": lambda: F.coalesce("mtime", F.lit(0.0)),
}


def visible(members: DataFrame, wanted: str | None = None, query: str = "") -> DataFrame:
    """Members of one kind whose name, or whose cluster's title, holds the query, in either case."""
    keep: Column = F.lit(True)
    if wanted is not None:
        keep = keep & shown_as("path", wanted)
    if query:
        title = F.lower(F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))
        keep = keep & (matches_text("path", query) | title.contains(query.lower()))
    return members.where(keep)


def ordered(members: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Adds group_pos and pos_in_group: clusters by the sort key of their first file, files by their own."""
    key = SORTS[by]()
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    first = members.groupBy("cluster_id").agg(F.min_by(key, F.struct("pos", "path")).alias("head"))
    first = numbered(first, "group_pos", way(F.col("head")), F.col("cluster_id")).select("cluster_id", "group_pos")
    within = Window.partitionBy("cluster_id").orderBy(way(key), "path")
    return members.withColumn("pos_in_group", F.row_number().over(within)).join(first, "cluster_id")


def statistics(members: DataFrame) -> DataFrame:
    """(kind, files, bytes, dups, share): per kind, files after the first of their cluster count as dups."""
    nth = Window.partitionBy("cluster_id").orderBy("pos", "path")
    rows = members.select(kind().alias("kind"), F.coalesce("size", F.lit(0)).alias("size"), (F.row_number().over(nth) > 1).cast("int").alias("dup"))
    each = rows.groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("dup").alias("dups"))
    share = F.floor(F.col("files") * 100 / F.sum("files").over(Window.partitionBy())).cast("int")
    return each.withColumn("share", share)


def savings(members: DataFrame, checked: DataFrame) -> DataFrame:
    """(files, bytes) of the members that are checked."""
    rows = members.join(checked.select("path").distinct(), "path", "left_semi").dropDuplicates(["path"])
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def check_states(members: DataFrame, checked: DataFrame) -> DataFrame:
    """(cluster_id, state): all, none or some of a cluster's non-reference members are checked."""
    marks = checked.select("path").distinct().withColumn("on", F.lit(True))
    rows = members.where(~F.coalesce("is_ref", F.lit(False))).join(marks, "path", "left").select("cluster_id", F.col("on").isNotNull().alias("on"))
    state = F.when(F.bool_and("on"), "all").when(F.bool_or("on"), "some").otherwise("none")
    return rows.groupBy("cluster_id").agg(state.alias("state"))


def toggled(checked: DataFrame, members: DataFrame, targets: DataFrame, on: bool) -> DataFrame:
    """The selection after setting the targets; references stay as they are."""
    free = members.where(~F.coalesce("is_ref", F.lit(False))).select("path").distinct()
    touched = targets.select("path").distinct().join(free, "path", "left_semi")
    now = checked.select("path")
    return now.union(touched).distinct() if on else now.join(touched, "path", "left_anti").distinct()


def watched(members: DataFrame) -> DataFrame:
    """The folders that hold members."""
    return members.select(parent().alias("folder")).distinct()


def move_plan(selected: DataFrame, folder: str) -> DataFrame:
    """(src, dst, status): base names into a folder; of files with one name the first by path may move."""
    nth = F.row_number().over(Window.partitionBy(basename()).orderBy("path"))
    plan = selected.select("path").distinct().select(F.col("path").alias("src"), F.concat(F.lit(folder.rstrip("/") + "/"), basename()).alias("dst"), nth.alias("n"))
    return plan.select("src", "dst", F.when(F.col("n") == 1, "moved").otherwise("failed").alias("status"))


def counters(log: DataFrame) -> DataFrame:
    """One row of deleted, moved, failed from an action log (path, status)."""
    return log.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("deleted", "moved", "failed")])


def stride_sample(rows: DataFrame, order: str, most: int = 50) -> DataFrame:
    """At most `most` rows at equal distances in order, all if there are no more."""
    step = max(1, rows.count() // most)
    at = F.col("__at_all") - 1
    return numbered(rows, "__at_all", order).where((at % step == 0) & (at < step * most)).drop("__at_all")
