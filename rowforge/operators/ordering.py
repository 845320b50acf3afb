"""Positions in an order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Up to so many rows one task numbers them; beyond, Spark's range partitions are numbered apart.
ONE_TASK = 200_000
#: About so many rows go into a range.
PER_RANGE = 2_000_000
Order = list[tuple[str, bool]]  # columns, each with True for descending


def sort_columns(order: Order) -> list[Column]:
    """Ascending with nulls first, descending with nulls last."""
    return [F.desc_nulls_last(c) if desc else F.asc_nulls_first(c) for c, desc in order]


def positions(df: DataFrame, order: Order, name: str = "pos", total: int | None = None, one_task: int = ONE_TASK, per_range: int = PER_RANGE) -> DataFrame:
    """``df`` with the dense position, from 1, of each row in a total order.

    Larger inputs are range-partitioned by the whole sort key, ties included, so that a key which many rows share is
    cut too, and sorted and written once; a row's place in its partition and the counts of the partitions before give its
    position. There are as many ranges as the rows ask for, and one number of each is broadcast.
    """
    total = df.count() if total is None else total
    if total <= one_task:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*sort_columns(order))).cast("long"))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // per_range + 1)
    laid = df.repartitionByRange(ranges, *sort_columns(order)).sortWithinPartitions(*sort_columns(order))
    # the partition's number in the upper 31 bits, the row's place in it in the lower 33
    laid = cut(laid.withColumn("__at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    placed = laid.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__offset", "__at")
