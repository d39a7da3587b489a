"""Sums that come out bit for bit the same however the rows are dealt.

Rows are added in a tree whose shape follows from their frame numbers alone: 128 frames in order
to a block, 128 blocks in order to the next, and so on, so that rounding depends neither on
partitions nor on the order in which tasks end, and grows with the logarithm of the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a level that make one of the next, as a power of two.
FAN = 7


def _level(df: DataFrame, part: list[str], place: Column) -> DataFrame:
    """(part, place, _v): the values under each place, added in the order of what they had."""
    in_order = F.sort_array(F.collect_list(F.struct("_at", "_v")))
    g = df.groupBy(*part, place.alias("_to")).agg(in_order.alias("s"))
    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    return g.select(*part, F.col("_to").alias("_at"), F.aggregate(rest, F.col("s")[0]["_v"], lambda acc, s: acc + s["_v"]).alias("_v"))


def tree_sum(df: DataFrame, part: list[str], order: str, value: Column, out: str = "total") -> DataFrame:
    """(part, out): the sum of value over each partition.  order must be whole numbers and tell the rows of a partition apart
    (rows that share one are added in order of value); null values and rows without a place are left out; a partition of none has no row.

    Two levels share a shuffle: rows move once to blocks of 16,384 frames, then one row for each of these to blocks
    of 2^28 frames, so that no task gathers a whole partition's rows.
    """
    rows = df.select(*part, F.col(order).cast("long").alias("_at"), value.cast("double").alias("_v")).where("_at is not null and _v is not null")
    up = lambda n: F.shiftright("_at", n)
    for _ in range(2):
        # rows that are dealt by the wider block lie together for the narrower one too
        rows = rows.withColumn("_wide", up(2 * FAN)).repartition(*part, "_wide")
        rows = _level(rows, [*part, "_wide"], up(FAN))
        rows = _level(rows, [*part, "_wide"], up(FAN)).drop("_wide")
    return _level(rows, part, F.lit(0)).select(*part, F.col("_v").alias(out))
