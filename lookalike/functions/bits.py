"""Frame hashes: bits from brightness gradients, distances between sets of hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 5, 59


def gradient_hash(cells: Column) -> Column:
    """64 bits of a 9 x 8 grid, row by row, first bit highest: whether a cell is brighter than the one left of it."""
    spot = lambda i: (F.floor(i / 8) * 9 + i % 8).cast("int")
    bit = lambda i: F.when(F.get(cells, spot(i) + 1) > F.get(cells, spot(i)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda h, i: F.shiftleft(h, 1).bitwiseOR(bit(i)))


def informative(hashes: str) -> Column:
    """Without nulls and near-uniform frames."""
    return F.filter(hashes, lambda x: F.bit_count(x).between(LEAST_BITS, MOST_BITS))


def least_distance(left: str, right: str) -> Column:
    """The fewest differing bits between an informative hash of each side; null if a side has none."""
    each = F.transform(informative(left), lambda x: F.array_min(F.transform(informative(right), lambda y: F.bit_count(x.bitwiseXOR(y)))))
    return F.array_min(each)
