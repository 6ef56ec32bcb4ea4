"""Distinct counts that can be merged: sketches kept beside the counts of a stage.

A count of different authors cannot be added up over days, a sketch can. One pass
writes a sketch (theta, the smallest hashes of its items) for each group and day; months, years and totals are
unions of these small rows, and further days are added without reading old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes kept by a sketch as a power of two: the 2^14 smallest give a standard error below 1 %.
LOG_ENTRIES = 14


def sketched(df: DataFrame, by: Sequence[str], item: str, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """Rows and a sketch of the different items, per key. NULL items are counted as rows only."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(item, F.lit(log_entries)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """The same for coarser keys, from sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.theta_union_agg("sketch", F.lit(LOG_ENTRIES)).alias("sketch"))


def estimated(sketches: DataFrame, name: str = "n_different") -> DataFrame:
    """Sketches replaced by their estimates."""
    return sketches.withColumn(name, F.theta_sketch_estimate("sketch")).drop("sketch")


def distinct_by_grain(sketches: DataFrame, date: str, group: str) -> DataFrame:
    """Rows and different items per group for every month, year and in all, from daily sketches.

    Days are merged to months, months to years and years to totals, so each step reads the step before.
    """
    months = merged(sketches, [group, F.trunc(date, "month").alias("start")])
    years = merged(months, [group, F.trunc("start", "year").alias("start")])
    totals = merged(years, [group]).withColumn("start", F.lit(None).cast("date"))
    grains = (("month", months), ("year", years), ("all", totals))
    parts = [estimated(df).select(F.lit(grain).alias("grain"), group, "start", "n", "n_different") for grain, df in grains]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
