"""The catalog of scanned files: its schema and its current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("phash", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("codec", T.StringType()),
        T.StructField("sharpness", T.DoubleType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("watermark", T.DoubleType()),
        T.StructField("dhash", T.ArrayType(T.LongType())),
        T.StructField("vector", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("faces", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("last_scan", T.TimestampType()),
        T.StructField("mode", T.StringType()),
    ]
)

#: Sorts before every real scan time.
NEVER = -(2**62)
#: What decides between different writes of one key at one scan time, the same whatever columns are asked for.
TIES = ("size", "mtime")


def scan_order(last_scan: str = "last_scan") -> Column:
    """Scan time as a number; null sorts before all."""
    return F.coalesce(F.unix_micros(F.col(last_scan)), F.lit(NEVER))


def current_rows(catalog: DataFrame, columns: list[str], mode: str | None = None) -> DataFrame:
    """The newest write of each (path, mode): the key and the given columns.

    Rows with a null path or mode have no key and are left out. Of writes with one scan time the one of
    greatest size stays, then of latest mtime (where the catalog has these columns; null before all, NaN after all),
    then the greatest by the given columns, so repeated rows collapse and ties are settled by value.
    One aggregation with map-side combining: only the columns asked for are shuffled, and a key
    written any number of times is combined before the shuffle.
    """
    if mode is not None:
        catalog = catalog.where(F.col("mode") == mode)
    ties = [F.col(c).alias(f"__{c}") for c in TIES if c in catalog.columns]
    newest = F.max(F.struct(scan_order().alias("__at"), *ties, *columns)).alias("__row")
    keys = ["path"] if mode is not None else ["path", "mode"]  # rows of one mode are left partitioned by path, for joins
    kept = catalog.where(F.col("path").isNotNull() & F.col("mode").isNotNull()).groupBy(*keys).agg(newest)
    return kept.select("path", F.lit(mode).alias("mode") if mode is not None else "mode", *[F.col(f"__row.{c}").alias(c) for c in columns])
