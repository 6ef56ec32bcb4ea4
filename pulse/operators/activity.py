"""Counts of activity over groups, flags and calendar grains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.timefx import calendar_parts, time_text
from pulse.operators.joins import salted_join


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key. Partial counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def larger_than(counts: DataFrame, minimum: int, column: str = "n") -> DataFrame:
    """Groups above a size."""
    return counts.filter(F.col(column) > minimum)


def in_large_groups(df: DataFrame, group: str, minimum: int, spread: Sequence[str]) -> DataFrame:
    """Rows of the groups above a size. Such groups are hot keys by definition,
    so each one is split over ``spread`` for the semi-join."""
    groups = larger_than(count_by(df, [group]), minimum).select(group)
    return salted_join(df, groups, [group], spread, "left_semi")


def top_n(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The n largest groups; equal counts are ordered by name.

    Sort and limit together are planned as a bounded heap per task.
    """
    return count_by(df, [key], name).orderBy(F.desc(name), F.asc(key)).limit(n)


def top_n_within(counts: DataFrame, within: Sequence[str], key: str, n: int,
                 name: str = "n", rank: str = "rank") -> DataFrame:
    """The n largest rows of each class.

    The rank filter reaches below the shuffle as a per-task group limit, so at
    most n rows per class and task meet in one place.
    """
    order = Window.partitionBy(*within).orderBy(F.desc(name), F.asc(key))
    return counts.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def ranked_panel(df: DataFrame, key: str, flag: str, n: int, labels: tuple[str, str]) -> DataFrame:
    """The n largest groups with the flag unset and set, side by side by rank."""
    ranked = top_n_within(count_by(df, [flag, key]), [flag], key, n)
    off, on = labels
    return ranked.groupBy("rank").agg(
        F.max(F.when(~F.col(flag), F.col(key))).alias(off),
        F.max(F.when(F.col(flag), F.col(key))).alias(on),
    )


def hourly_base(df: DataFrame, time: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per date and hour: the one scan that every coarser grain is built on.

    A year holds 8,784 such rows per key at most.
    """
    parts = calendar_parts(time)
    return df.groupBy(
        *keys, parts["date"].alias("date"), parts["hour"].alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))


def activity_by_grain(df: DataFrame, time: Column, month_year: int) -> DataFrame:
    """Activity by month (of one year), by date and by hour from a single scan."""
    base = hourly_base(df, time).withColumn(
        "month", F.when(F.year("date") == month_year, F.month("date"))
    )
    sets = base.groupingSets(
        [[F.col("month")], [F.col("date")], [F.col("hour")]],
        F.col("month"), F.col("date"), F.col("hour"),
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    # grouping_id has one bit per column, set where the column was rolled up
    grain = F.when(F.col("gid") == 3, "month").when(F.col("gid") == 5, "date").otherwise("hour")
    value = F.coalesce(
        F.lpad(F.col("month").cast("string"), 2, "0"), F.col("date").cast("string"),
        F.lpad(F.col("hour").cast("string"), 2, "0"),
    )
    return sets.select(grain.alias("grain"), value.alias("bucket"), "n").filter(
        F.col("bucket").isNotNull()
    )


def activity_by_weekday(df: DataFrame, time: Column, flag: Column) -> DataFrame:
    """Activity by day of week: all rows, rows with the flag and rows without."""
    base = hourly_base(df.withColumn("flag", flag), time, ["flag"])
    n = F.col("n")
    return base.groupBy(F.dayofweek("date").alias("day_of_week")).agg(
        F.sum(n).alias("n_all"),
        F.sum(F.when(F.col("flag"), n).otherwise(0)).alias("n_flagged"),
        F.sum(F.when(~F.col("flag"), n).otherwise(0)).alias("n_unflagged"),
    )


def daily_counts(df: DataFrame, time: Column, name: str = "n") -> DataFrame:
    return df.groupBy(F.to_date(time).alias("date")).agg(F.count(F.lit(1)).alias(name))


def time_span(df: DataFrame, time: Column) -> DataFrame:
    """First and last event time, as text."""
    return df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).select(
        time_text(F.col("lo")).alias("first_time"), time_text(F.col("hi")).alias("last_time")
    )


def activity_vs_size(df: DataFrame, group: str, author: str, item: str, min_authors: int = 10,
                     min_items: int = 1000, approx: bool = False) -> DataFrame:
    """Items, distinct authors and items per author, for groups above two sizes.

    The exact form first reduces to one row per (group, author), so a hot group
    is spread over its authors before it is counted. ``approx`` trades that
    shuffle for a sketch.
    """
    if approx:
        sizes = df.groupBy(group).agg(
            F.approx_count_distinct(author).alias("n_authors"), F.count(item).alias("n_items")
        )
    else:
        pairs = df.groupBy(group, author).agg(F.count(item).alias("items"))
        sizes = pairs.groupBy(group).agg(
            F.count(author).alias("n_authors"), F.sum("items").alias("n_items")
        )
    return sizes.filter(
        (F.col("n_authors") > min_authors) & (F.col("n_items") > min_items)
    ).withColumn("items_per_author", F.col("n_items") / F.col("n_authors"))


def flag_rates(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = (),
               totals: Sequence[str] = ()) -> DataFrame:
    """Share of rows where each flag holds; ``totals`` are summed instead."""
    def measure(name: str, flag: Column) -> Column:
        value = flag.cast("int")
        return F.sum(value).alias(f"{name}_sum") if name in totals else F.avg(value).alias(name)

    return df.groupBy(*by).agg(*[measure(n, f) for n, f in flags.items()])


def mean_by(df: DataFrame, means: Mapping[str, Column], by: Sequence[str],
            count_name: str = "n") -> DataFrame:
    """Row count and several averages per key."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(count_name), *[F.avg(c).alias(n) for n, c in means.items()]
    )


def class_totals(daily: DataFrame, column: str, low: float, high: float, label: str,
                 count: str) -> DataFrame:
    """Sum of daily counts per class over the days whose value lies in a range."""
    return daily.filter(F.col(column).between(low, high)).groupBy(label).agg(
        F.sum(count).alias("total")
    )


def crosstab(df: DataFrame, first: str, second: str) -> DataFrame:
    return count_by(df, [first, second])


def controversial_groups(comments: DataFrame, posts: DataFrame, group: str, measure: Column,
                         minimum: int, n: int) -> DataFrame:
    """The n most controversial groups above a size, with both counts.

    Both tables are reduced to one row per group before they meet.
    """
    scored = comments.groupBy(group).agg(
        F.avg(measure).alias("controversiality"), F.count(F.lit(1)).alias("n_comments")
    ).filter(F.col("n_comments") > minimum)
    return (
        scored.join(count_by(posts, [group], "n_posts"), [group])
        .orderBy(F.desc("controversiality"), F.asc(group))
        .limit(n)
    )
