"""Which file of a cluster to keep, and which to mark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.functions.media import bucket, effective_area, finite, quality_score, smart_score
from lookalike.functions.paths import holds_segment

Order = Callable[[bool, Column | None], list[Column]]


def _size() -> Column:
    return F.coalesce(F.col("size"), F.lit(0)).desc()


def _cascade(keep_newer: bool, ratio: Column | None) -> list[Column]:
    at = finite("mtime")
    return [bucket(effective_area(content_ratio=ratio)).desc(), _size(), at.desc() if keep_newer else at.asc()]


#: Strategies by name, each the order in which files are preferred. Add entries to extend.
STRATEGIES: dict[str, Order] = {
    "cascade": _cascade,
    "quality": lambda newer, ratio: [F.round(quality_score(ratio), 6).desc()],
    "size": lambda newer, ratio: [_size()],
    "date": lambda newer, ratio: [F.coalesce(F.col("mtime"), F.lit(float("inf"))).asc()],
    "smart": lambda newer, ratio: [F.round(smart_score(), 6).desc()],
}


def truthy(value: object) -> bool:
    """Settings stored as a boolean, a number or a word."""
    if isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return bool(value)


def ranked(
    members: DataFrame, strategy: str = "cascade", keep_newer: object = False, protected: list[str] | None = None, disliked: list[str] | None = None
) -> DataFrame:
    """Adds keep_rank within cluster_id; 1 is kept. Files in a protected folder come before all others,
    files in a disliked one after. Unknown strategies fall back to smart; ties by path. A column content_ratio, if there
    is one, is the share of each picture inside dark bars; a null one reads as 1."""
    ratio = F.col("content_ratio") if "content_ratio" in members.columns else None
    order = STRATEGIES.get(strategy, STRATEGIES["smart"])(truthy(keep_newer), ratio)
    tier = F.when(holds_segment("path", protected or []), 0).when(holds_segment("path", disliked or []), 2).otherwise(1)
    best = Window.partitionBy("cluster_id").orderBy(tier, *order, "path")
    return members.withColumn("keep_rank", F.row_number().over(best))


def keepers(members: DataFrame, strategy: str = "cascade", **options: object) -> DataFrame:
    """(cluster_id, path) of the kept file of every cluster of two or more different paths."""
    top = ranked(members.dropDuplicates(["cluster_id", "path"]), strategy, **options).where(F.col("keep_rank") <= 2)
    kept = top.groupBy("cluster_id").agg(F.min_by("path", "keep_rank").alias("path"), F.count("*").alias("n"))
    return kept.where(F.col("n") == 2).select("cluster_id", "path")


def marked(members: DataFrame, strategy: str = "cascade", **options: object) -> DataFrame:
    """Members to remove: all but the keeper, of clusters of two or more; references are never marked."""
    once = members.dropDuplicates(["cluster_id", "path"])
    other = ranked(once, strategy, **options).where(F.col("keep_rank") > 1)
    return other.where(~F.coalesce(F.col("is_ref"), F.lit(False)))
