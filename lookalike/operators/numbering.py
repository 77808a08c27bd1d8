"""Dense numbers over a total order, without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lookalike.session import stage_table

#: A row's place within its partition, in the low bits of monotonically_increasing_id.
IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds a column of whole numbers from 1 in the given order, whose last part should tell all rows apart.

    Rows are partitioned by ranges and sorted there; a row's number is its place in its partition plus the rows of
    the partitions before. Only the counts by partition, one row each, are added up in one task.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in order]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit(IN_PARTITION)).alias("__at"))
    placed = stage_table(placed, "numbered")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")
