"""Labels within a cluster: kind of duplicate, best resolution, reference folders, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.media import area, aspect
from lookalike.functions.paths import under

SAME_ASPECT = 0.03


def dup_kind(members: DataFrame) -> DataFrame:
    """Adds dup_kind against the base, the first of its cluster by pos: reference for itself; quality where
    the aspect ratio is within 3 % of the base's and the area differs; else exact where the content hash
    is the base's; else semantic. members: cluster_id, path, pos, phash, resolution."""
    base = Window.partitionBy("cluster_id").orderBy("pos", "path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hash_, ratio, size = (F.first(c).over(base) for c in (F.col("phash"), aspect(), area()))
    first = F.first("path").over(base)
    alike = (F.abs(aspect() - ratio) <= SAME_ASPECT * ratio) & (area() != size)
    label = (
        F.when(F.col("path") == first, "reference")
        .when(F.coalesce(alike, F.lit(False)), "quality")
        .when(F.coalesce((F.col("phash") == hash_) & (F.col("phash") != ""), F.lit(False)), "exact")
        .otherwise("semantic")
    )
    return members.withColumn("dup_kind", label)


def keep_priority(members: DataFrame) -> DataFrame:
    """Adds keep_priority: the file of greatest area, then size, in its cluster; first by pos on ties."""
    best = Window.partitionBy("cluster_id").orderBy(area().desc(), F.coalesce("size", F.lit(0)).desc(), "pos", "path")
    return members.withColumn("keep_priority", F.row_number().over(best) == 1)


def reference(members: DataFrame, root: str) -> DataFrame:
    return members.withColumn("is_ref", F.coalesce(under("path", root), F.lit(False)))


def crossing(members: DataFrame) -> DataFrame:
    """Members of the clusters that have files both inside and outside the reference folder."""
    both = members.groupBy("cluster_id").agg(F.bool_or("is_ref").alias("x"), F.bool_or(~F.col("is_ref")).alias("y")).where("x AND y")
    return members.join(both.select("cluster_id"), "cluster_id", "left_semi")


def pages(members: DataFrame, per_page: int = 2) -> DataFrame:
    """Adds place and page of a side-by-side view: references first, then by pos."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("is_ref").desc(), "pos", "path")
    place = F.row_number().over(order)
    return members.withColumn("place", place).withColumn("page", F.floor((F.col("place") - 1) / per_page).cast("int"))


def nearest_index(count: Column, percent: Column) -> Column:
    """Index of the item at a share of a list of `count`."""
    return F.greatest(F.lit(0), F.least((count * percent / 100).cast("int"), count - 1))


def held_index(count: Column, index: Column) -> Column:
    """An index shared by two lists: the shorter one stays at its last item."""
    return F.greatest(F.lit(0), F.least(index, count - 1))
