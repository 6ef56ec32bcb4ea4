"""Exact quantiles without gathering a group in one task.

The built-in exact ``percentile`` keeps a map of every distinct value of a group
in one task. Here the values are first counted into a histogram. Ranges of it that hold
a wanted rank are cut, again and again, until they are short enough to be ordered by a
task; all others are dropped, so each round has a fraction of the rows of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.operators.joins import null_safe_join
from pulse.session import scratch_path
from pulse.sources.sinks import stage

ROWS_PER_RANGE = 100_000
#: Parts that a long range is cut into.
CUTS = 32


def _histogram(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Rows per key and value, staged; NULL is a value here, so that no key is lost."""
    counts = df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return stage(counts, scratch_path(df.sparkSession, "histogram"))


def _ranks(total: Column, p: float) -> tuple[Column, Column, Column]:
    """Zero-based ranks on both sides of a quantile, and the weight of the upper."""
    place = F.lit(p) * (total - 1)
    low = F.floor(place)
    return low, F.ceil(place), place - low


def _holding(ranges: DataFrame) -> DataFrame:
    """Ranges that hold a wanted rank, with these ranks only."""
    first, end = F.col("start"), F.col("start") + F.col("size")
    return ranges.withColumn("wanted", F.filter("wanted", lambda w: (w["rank"] >= first) & (w["rank"] < end))).filter(
        F.size("wanted") > 0)


def _refined(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ranges cut at their own quantiles: the rows and the ranges that hold a wanted rank.

    Any cuts give the same quantiles, good ones give ranges of equal length. The least
    value is always a cut, so a range of several values never stays whole.
    """
    spark, on = rows.sparkSession, [*keys, "range"]
    inside = null_safe_join(rows, ranges.select(*on), on)
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = stage(inside.groupBy(*on).agg(F.array_union(
        F.array(F.min("value")), F.percentile_approx("value", shares, 10 * CUTS)).alias("cuts")),
        scratch_path(spark, "quantile-cuts"))
    below = F.size(F.filter("cuts", lambda cut: cut < F.col("value")))
    # Numbers of all ranges differ, those of later rounds as well.
    cut = null_safe_join(inside, cuts, on).select(
        *keys, "value", "n", F.col("range").alias("parent"), (F.col("range") * (CUTS + 2) + below + 1).alias("range"))
    parents = ranges.select(*keys, F.col("range").alias("parent"), F.col("start").alias("first"), "wanted")
    # At most CUTS + 1 rows for each range that was cut.
    before = Window.partitionBy(*keys, "parent").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*on, "parent").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows")).withColumn(
        "before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    held = stage(_holding(null_safe_join(sizes, parents, [*keys, "parent"]).withColumn(
        "start", F.col("first") + F.col("before"))).select(*on, "start", "size", "rows", "wanted"),
        scratch_path(spark, "quantile-ranges"))
    left = null_safe_join(cut.drop("parent"), held.select(*on), on)
    return stage(left, scratch_path(spark, "quantile-rows")), held


def _from_histogram(hist: DataFrame, probs: Mapping[str, float], keys: Sequence[str],
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Quantiles per key of a staged (keys, value, n) table; a key with NULLs only has NULL quantiles.

    Values start as one range a key. As long as a range that holds a wanted rank has more
    than ``rows_per_range`` values it is cut; ranges without a wanted rank are dropped.
    """
    spark, on = hist.sparkSession, [*keys, "range"]
    wanted = []
    for name, p in probs.items():
        low, high, weight = _ranks(F.col("size"), p)
        for side, rank in (("low", low), ("high", high)):
            wanted.append(F.struct(
                F.lit(name).alias("name"), F.lit(side).alias("side"),
                rank.cast("long").alias("rank"), weight.cast("double").alias("weight"),
            ))
    rows = hist.filter(F.col("value").isNotNull()).withColumn("range", F.lit(1).cast("long"))
    ranges = stage(rows.groupBy(*on).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows")).select(
        *on, F.lit(0).cast("long").alias("start"), "size", "rows", F.array(*wanted).alias("wanted")),
        scratch_path(spark, "quantile-ranges"))
    ready = []
    while True:
        short = ranges.filter(F.col("rows") <= rows_per_range)
        ready.append(null_safe_join(rows, short.select(*on, "start", "wanted"), on))
        ranges = ranges.filter(F.col("rows") > rows_per_range)
        if ranges.isEmpty():
            break
        rows, ranges = _refined(rows, ranges, keys)

    # only short ranges that hold a wanted rank are ordered
    upto = Window.partitionBy(*on).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("start") + F.col("upto")
    hits = (
        reduce(DataFrame.unionByName, ready)
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("hits", F.filter(
            "wanted", lambda w: (w["rank"] >= last - F.col("n")) & (w["rank"] < last)
        ))
        .select(*keys, "value", F.explode("hits").alias("hit"))
    )

    def quantile(name: str) -> Column:
        def side(s: str) -> Column:
            here = (F.col("hit.name") == name) & (F.col("hit.side") == s)
            return F.max(F.when(here, F.col("value"))).cast("double")

        weight = F.max(F.when(F.col("hit.name") == name, F.col("hit.weight")))
        low, high = side("low"), side("high")
        return (low + (high - low) * weight).alias(name)

    found = hits.groupBy(*keys).agg(*[quantile(name) for name in probs])
    return null_safe_join(hist.select(*keys).distinct(), found, keys, "left")


def exact_quantiles(df: DataFrame, column: str, probs: Mapping[str, float],
                    by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Linear-interpolated quantiles, one named column each, per key or overall."""
    hist = _histogram(df, column, by)
    if by:
        return _from_histogram(hist, probs, list(by), rows_per_range)
    # The key of all rows alike is a column of the table, so that windows are dealt by it.
    whole = hist.withColumn("all_rows", F.isnotnull("n"))
    return _from_histogram(whole, probs, ["all_rows"], rows_per_range).drop("all_rows")


def approx_quantiles(df: DataFrame, column: str, probs: Mapping[str, float],
                     by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Sketch-based quantiles in a single pass."""
    return df.groupBy(*by).agg(*[
        F.percentile_approx(column, p, accuracy).cast("double").alias(name)
        for name, p in probs.items()
    ])


# The columns of the published quantile table.
REPORT_PROBS = {"q1": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}


def quantile_report(df: DataFrame, columns: Sequence[str], by: str,
                    approx: bool = False) -> DataFrame:
    """Minimum, quantiles, mean to two places and maximum of each column per period.

    All columns share one pass: their values are counted into one histogram, and
    ends and means come from it as well.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value"))
        for c in columns
    ])
    long = df.select(by, F.inline(cells))
    keys = ["feature_name", by]
    hist = _histogram(long, "value", keys)
    ends = hist.groupBy(*keys).agg(
        F.min("value").alias("min"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), 2)
        .alias("mean"),
        F.max("value").alias("max"),
    )
    quantiles = (
        approx_quantiles(long, "value", REPORT_PROBS, keys) if approx
        else _from_histogram(hist, REPORT_PROBS, keys)
    )
    return null_safe_join(ends, quantiles, keys).select(
        *keys, "min", "q1", "q25", "median", "mean", "q75", "q99", "max"
    )


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """Number of texts per length."""
    return df.groupBy(length.cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n"))
