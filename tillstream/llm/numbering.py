"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm.tables import written

#: Bits of a row's place in its partition, in Spark's increasing ids.
_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in the order of their group, from 0 without gaps, as column ``name``.

    All groups are sorted together by ranges, so that a large group is split over tasks like any other, and rows that are
    equal in the whole order too. Of each range only its groups and their numbers of rows are summed up. Rows that the
    order does not tell apart get their places in any order. ``group`` holds no null; an empty table gives an empty one.
    """
    keys = [F.col(group), *order]
    # Written first: Spark reads the rows twice, once to find the ranges.
    dealt = written(rows).withColumn("_equal", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, "_equal").sortWithinPartitions(*keys, "_equal").drop("_equal")
    at = F.monotonically_increasing_id()
    placed = written(dealt.withColumn("_range", F.shiftright(at, _BITS)).withColumn("_at", at.bitwiseAND((1 << _BITS) - 1)))
    sums = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = placed.join(sums, [group, "_range"]).withColumn(name, F.col("_at") + F.col("_shift"))
    return rows.drop("_range", "_at", "_shift")
