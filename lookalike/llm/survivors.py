"""The record to keep of each duplicate group, and a record merged from the best field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.catalog import current_rows

FREE_WATERMARK, WATERMARK_SLOPE, MOST_PENALTY = 0.012, 12.0, 0.30
MILLISECONDS_FROM = 1e11
FIELDS = ["resolution", "size", "mtime", "watermark"]


def area(resolution: str = "resolution") -> Column:
    """Width x height; 0 unless the text is two whole numbers around x, X or the multiplication sign."""
    pattern = r"^\s*([0-9]+)\s*[xX×]\s*([0-9]+)\s*$"
    side = [F.regexp_extract(F.col(resolution), pattern, g).try_cast("double") for g in (1, 2)]
    return F.coalesce(side[0] * side[1], F.lit(0.0))


def number(column: Column) -> Column:
    """Null, NaN and negative values read as 0."""
    return F.when(F.isnan(column) | (column < 0), 0.0).otherwise(F.coalesce(column, F.lit(0.0)))


def penalty(watermark: str = "watermark") -> Column:
    score = number(F.col(watermark))
    return F.when(score <= FREE_WATERMARK, 0.0).otherwise(F.least(F.lit(MOST_PENALTY), (score - FREE_WATERMARK) * WATERMARK_SLOPE))


def seconds(mtime: str = "mtime") -> Column:
    at = F.when(F.isnan(F.col(mtime)), 0.0).otherwise(F.coalesce(F.col(mtime), F.lit(0.0)))
    return F.when(at > MILLISECONDS_FROM, at / 1000.0).otherwise(at)


def members(clusters: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cluster_id, path, area, bytes, newest, and the four fields): each catalogued member once.

    Only paths named by a cluster are aggregated; repeated memberships combine before the shuffle.
    """
    named = clusters.where(F.col("cluster_id").isNotNull() & F.col("path").isNotNull()).select("cluster_id", "path").distinct()
    wanted = catalog.join(named.select("path").distinct(), "path", "left_semi")
    rows = current_rows(wanted, FIELDS, "visual").select(
        "path",
        (area() * (1 - penalty())).alias("area"),
        F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("bytes"),
        seconds().alias("newest"),
        *FIELDS,
    )
    return named.join(rows, "path")


def ranked(clusters: DataFrame, catalog: DataFrame, keep: int) -> DataFrame:
    """The best `keep` members of each cluster: effective area, size, mtime, then the smallest path.

    A ranking limited to a constant runs before the shuffle too, so a cluster of any size leaves each
    task with at most `keep` rows.
    """
    best = Window.partitionBy("cluster_id").orderBy(F.desc("area"), F.desc("bytes"), F.desc("newest"), "path")
    return members(clusters, catalog).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def survivors(clusters: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cluster_id, path): the file to keep of each cluster with two or more different catalogued paths.

    Null cluster ids and null paths are no members; members without a current visual row are passed
    over; repeated rows count once; empty tables give no rows; other columns are not read.
    """
    top = ranked(clusters, catalog, 2).groupBy("cluster_id")
    return top.agg(F.min_by("path", "rank").alias("path"), F.count("*").alias("n")).where(F.col("n") == 2).select("cluster_id", "path")


def merged(clusters: DataFrame, catalog: DataFrame) -> DataFrame:
    """(cluster_id, path, members, area, bytes, newest, clean): a record built field by field.

    path is the survivor's; area is the greatest effective area, bytes the greatest size, newest the latest
    mtime in seconds, clean the least known watermark score (null if no member has a valid one).
    Aggregated with map-side combining, so no group is gathered.
    """
    valid = F.when(~F.isnan("watermark") & (F.col("watermark") >= 0), F.col("watermark"))
    fields = members(clusters, catalog).groupBy("cluster_id").agg(
        F.count("*").alias("members"), F.max("area").alias("area"), F.max("bytes").alias("bytes"),
        F.max("newest").alias("newest"), F.min(valid).alias("clean"),
    )
    return survivors(clusters, catalog).join(fields, "cluster_id").select("cluster_id", "path", "members", "area", "bytes", "newest", "clean")


_CURRENT = """
WITH cur AS (
  SELECT path, resolution, size, mtime, watermark FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scan DESC NULLS LAST,
      size DESC NULLS LAST, mtime DESC NULLS LAST, resolution DESC NULLS LAST, watermark DESC NULLS LAST) AS rn
    FROM metadata WHERE mode = 'visual' AND path IS NOT NULL) WHERE rn = 1),
r AS (
  SELECT path, watermark,
    CASE WHEN mtime IS NULL OR isnan(mtime) THEN 0 WHEN mtime > 1e11 THEN mtime / 1000 ELSE mtime END AS newest,
    greatest(coalesce(size, 0), 0) AS bytes,
    coalesce(try_cast(regexp_extract(resolution, '^\\s*([0-9]+)\\s*[xX×]\\s*([0-9]+)\\s*$', 1) AS double)
      * try_cast(regexp_extract(resolution, '^\\s*([0-9]+)\\s*[xX×]\\s*([0-9]+)\\s*$', 2) AS double), 0) AS px,
    CASE WHEN watermark IS NULL OR isnan(watermark) OR watermark < 0 THEN 0 ELSE watermark END AS wm FROM cur),
m AS (
  SELECT cluster_id, path, bytes, newest, watermark,
    px * (1 - CASE WHEN wm <= 0.012 THEN 0 ELSE least(0.30, (wm - 0.012) * 12.0) END) AS area
  FROM (SELECT DISTINCT cluster_id, path FROM clusters WHERE cluster_id IS NOT NULL) JOIN r USING (path)),
k AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY area DESC, bytes DESC, newest DESC, path) AS rn,
    count(*) OVER (PARTITION BY cluster_id) AS n FROM m)
"""
SQL = {
    "p5_found": _CURRENT + "SELECT cluster_id, path FROM k WHERE rn = 1 AND n > 1",
    "p5_merged": _CURRENT
    + """SELECT cluster_id, min(CASE WHEN rn = 1 THEN path END) AS path, count(*) AS members, max(area) AS area,
    max(bytes) AS bytes, max(newest) AS newest, min(CASE WHEN NOT isnan(watermark) AND watermark >= 0 THEN watermark END) AS clean
    FROM k WHERE n > 1 GROUP BY cluster_id""",
}
