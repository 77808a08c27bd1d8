"""Bringing a catalog up to date with a listing, and changing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.catalog import current_rows


def diff(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, size, mtime, status) of the listing (path, size, mtime) against one mode of the catalog.

    hit: size and mtime are equal and there is a vector; changed: another size or mtime; vectorless: equal
    but without a vector, so it is queued again; new: not in the catalog. Empty files are passed over.
    """
    known = catalog.select("path", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), (F.size("vector") > 0).alias("has"), F.lit(True).alias("known"))
    same = F.col("size").eqNullSafe(F.col("c_size")) & F.col("mtime").eqNullSafe(F.col("c_mtime"))
    status = (
        F.when(F.col("known").isNull(), "new").when(~same, "changed").when(F.col("has"), "hit").otherwise("vectorless")
    )
    listed = listing.where(F.col("size") > 0).dropDuplicates(["path"])
    return listed.join(known, "path", "left").select("path", "size", "mtime", status.alias("status"))


def pending(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    return diff(listing, catalog).where(F.col("status") != "hit").select("path", "size", "mtime")


def items(catalog: DataFrame) -> DataFrame:
    """The working set: rows with a vector, in the item schema."""
    return catalog.where(F.size("vector") > 0).drop("last_scan")


def upsert(catalog: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Newest write per (path, mode) of both; fresh rows without a vector are not stored."""
    stored = catalog.unionByName(fresh.where(F.size("vector") > 0))
    return current_rows(stored, columns)


def delete(catalog: DataFrame, paths: DataFrame, mode: str | None = None) -> DataFrame:
    """Without the given paths, in one mode or in all."""
    gone = paths.select("path").distinct()
    if mode is None:
        return catalog.join(gone, "path", "left_anti")
    return catalog.join(gone.withColumn("mode", F.lit(mode)), ["path", "mode"], "left_anti")


def move(catalog: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-key by moves (src, dst). Of rows that come to share a key the newest stays."""
    once = moves.groupBy("src").agg(F.max("dst").alias("dst"))
    keyed = catalog.join(once, catalog["path"] == once["src"], "left").withColumn("path", F.coalesce("dst", "path"))
    newest = Window.partitionBy("path", "mode").orderBy(F.col("last_scan").desc_nulls_last(), F.col("src").desc_nulls_last())
    return keyed.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") == 1).drop("__n", "src", "dst")


def collect_orphans(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalog rows whose file is still listed."""
    return catalog.join(listing.select("path").distinct(), "path", "left_semi")


def purge(catalog: DataFrame, mode: str | None = None) -> DataFrame:
    return catalog.limit(0) if mode is None else catalog.where(F.col("mode") != mode)
