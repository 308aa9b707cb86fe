"""Row numbers inside groups of any size, without a task per group.

Rows are dealt into ranges of (group, order) and sorted there. A row's number is its place in its
range, counted from the first row of its group there, plus the rows of the group in the ranges before:
a prefix sum over one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.session import bounded_broadcast, settle

_PLACE_BITS = 33


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Adds 1, 2, 3, ... in each group, in the given order; missing group values compare equal."""
    dealt = _dealt(df, group, order)
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_group", "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_group", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(name)
    return dealt.join(bounded_broadcast(offsets), ["_group", "_range"]).select(*df.columns, number)


def _dealt(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Rows with their `_group`, `_range` and `_place` in it, settled."""
    keys = [F.struct(*group).alias("_group")] if group else [F.lit(0).alias("_group")]
    grouped = df.select("*", *keys)
    return settle(
        grouped.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))),
        "numbered",
    )


def reserved(df: DataFrame, group: list[str], order: list[str | Column], size: str, last: DataFrame) -> DataFrame:
    """Rows that take `size` numbers each, dense in each group in the given order, with the first of them as `first_number`.

    Groups go on after `last_number` of `last` (group, last_number). `range_of_group` tells which of its
    group's ranges a row is in, from 0: no range of a group is more than one task had.
    """
    dealt = _dealt(df, group, order)
    ranges = Window.partitionBy("_group").orderBy("_range")
    inside = Window.partitionBy("_group", "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_group", "_range").agg(F.sum(size).alias("_n"))
    offsets = sizes.join(last.select(F.struct(*group).alias("_group"), "last_number"), "_group", "left").select(
        "_group", "_range", (F.row_number().over(ranges) - 1).alias("range_of_group"),
        (F.coalesce("last_number", F.lit(0)) + F.coalesce(F.sum("_n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"),
    )
    first = (F.col("_before") + F.coalesce("_inside", F.lit(0)) + 1).alias("first_number")
    counted = dealt.withColumn("_inside", F.sum(size).over(inside))
    return counted.join(offsets, ["_group", "_range"]).select(*df.columns, "range_of_group", first)


def pieces(df: DataFrame, group: list[str], order: list[str | Column], size: int) -> DataFrame:
    """Adds `piece`: 0, 1, 2, ... in each group, `size` rows each, and `ordinal`."""
    return numbered(df, group, order).withColumn("piece", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))
