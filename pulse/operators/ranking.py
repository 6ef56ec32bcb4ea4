"""Numbering and carrying values along a total order, without one task that holds all rows.

Rows are dealt into ranges of the order and written once, so that every later
use sees the same ranges. What happens inside a range is a window over that range;
what passes from one range to the next is one small row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.session import scratch_path
from pulse.sources.sinks import stage

PART, _ENDS = "order_range", "order_range_ends"


def ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the number of their range of the order, staged."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    return stage(dealt, scratch_path(spark, "ranges"))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows with their place in the order, from 0. ``order`` must leave no ties."""
    dealt = ranges(df, order)
    sizes = dealt.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).agg(
        F.collect_list(F.struct(PART, "n"))).scalar()
    before = F.aggregate(
        F.filter(_ENDS, lambda s: s[PART] < F.col(PART)), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    inside = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return dealt.withColumn(_ENDS, sizes).withColumn(name, before + inside - 1).drop(PART, _ENDS)


def summed_before(df: DataFrame, order: Sequence[Column], column: str, name: str) -> DataFrame:
    """Rows with the sum of a column over all rows before them. ``order`` must leave no ties."""
    dealt = ranges(df, order)
    sums = dealt.groupBy(PART).agg(F.sum(column).alias("s")).agg(F.collect_list(F.struct(PART, "s"))).scalar()
    zero = F.lit(0).cast("double")
    before = F.aggregate(F.filter(_ENDS, lambda e: e[PART] < F.col(PART)), zero, lambda a, e: a + e["s"])
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(_ENDS, sums).withColumn(
        name, before + F.coalesce(F.sum(column).over(inside), F.lit(0))).drop(PART, _ENDS)


def carried_forward(df: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    """NULLs filled with the last earlier value of each column along the order."""
    dealt = ranges(df, [order])
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    ends = dealt.groupBy(PART).agg(*last).agg(F.array_sort(F.collect_list(F.struct(PART, *columns)))).scalar()
    past = Window.partitionBy(PART).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def entering(column: str) -> Column:
        known = F.filter(_ENDS, lambda e: (e[PART] < F.col(PART)) & e[column].isNotNull())
        return F.try_element_at(known, F.lit(-1))[column]

    return dealt.withColumn(_ENDS, ends).withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(past), entering(c)) for c in columns}).drop(PART, _ENDS)
