"""Daily series: alignment, gap filling and joins with activity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.operators.joins import null_safe_join, one_row_per
from pulse.operators.ranking import carried_forward, numbered

#: Days of a block, and blocks of an era: one era holds all dates of the years 0 to 9999.
BLOCK_DAYS, _YEAR_ZERO = 2048, 719_528


def _days(bounds: DataFrame) -> DataFrame:
    """Consecutive dates between the columns lo and hi of a one-row frame."""
    return bounds.filter("lo <= hi").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """Consecutive dates, both ends included."""
    return _days(spark.range(1).select(F.lit(start).alias("lo"), F.lit(end).alias("hi")))


def calendar_of(df: DataFrame, date: str = "date") -> DataFrame:
    """Consecutive dates from the first to the last date of a table."""
    return _days(df.agg(F.min(date).alias("lo"), F.max(date).alias("hi")))


def align_on_first(first: DataFrame, *others: DataFrame, date: str = "date") -> DataFrame:
    """Several series beside each other on the dates of the first."""
    aligned = one_row_per(first, [date])
    for other in others:
        aligned = aligned.join(one_row_per(other, [date]), [date], "left")
    return aligned


def on_calendar(series: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """A series on every calendar day, NULL where it has no value."""
    return days.join(one_row_per(series, [date]), [date], "left")


def forward_fill(df: DataFrame, order: str, columns: Sequence[str],
                 by: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs with the last earlier value.

    With keys, each key holds one row per day. Without, the order is cut into
    ranges and the last value of each range is carried on, so a series of any
    length is filled.
    """
    if not by:
        return carried_forward(df, F.col(order), columns)
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def drop_seed(df: DataFrame, start: dt.date, date: str = "date") -> DataFrame:
    """Drop the days that only served to seed a fill."""
    return df.filter(F.col(date) >= F.lit(start))


def after_first(series: DataFrame, n: int, order: str = "date") -> DataFrame:
    """A series without its first n rows; ``order`` has no repeated value."""
    return numbered(series, [F.asc(order)], "row").filter(F.col("row") >= n).drop("row")


def gap_filled(series: DataFrame, columns: Sequence[str], days: DataFrame,
               start: dt.date | None = None) -> DataFrame:
    """A series on every calendar day, closed days filled forward."""
    filled = forward_fill(on_calendar(series, days), "date", columns)
    return drop_seed(filled, start) if start else filled


def daily_panel(first: DataFrame, second: DataFrame, series: DataFrame,
                counts: tuple[str, str]) -> DataFrame:
    """Two daily counts and a series, joined on the date and not on position."""
    both = first.join(second, ["date"], "full_outer")
    return both.join(one_row_per(series, ["date"]), ["date"], "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    )


def enrich_by_date(activity: DataFrame, series: DataFrame) -> DataFrame:
    """Every activity row with the series values of its date.

    Spark broadcasts the series if its size allows, and splits hot dates if not.
    """
    return activity.join(one_row_per(series, ["date"]), ["date"], "left")


def _block(date: str) -> Column:
    return F.floor((F.unix_date(date) + _YEAR_ZERO) / BLOCK_DAYS)


def with_next_date(df: DataFrame, name: str, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Rows (one per key and date) with the next date of their key, NULL for the last one.

    Rows look ahead inside their block of days. The last row of a block takes the first
    date of the key's next block, found the same way among blocks, of which a key has at
    most BLOCK_DAYS. So no window is longer than that, whatever the length of a series.
    """
    keys = list(by)
    blocked = df.withColumn("day_block", _block(date))
    inside = Window.partitionBy(*keys, "day_block").orderBy(date)
    firsts = blocked.groupBy(*keys, "day_block").agg(F.min(date).alias("first_date"))
    # An expression of the block, so that blocks without keys are dealt like any others.
    among = Window.partitionBy(*keys, F.floor(F.col("day_block") / BLOCK_DAYS)).orderBy("day_block")
    ahead = firsts.select(*keys, "day_block", F.lead("first_date").over(among).alias("block_ahead"))
    return null_safe_join(blocked.withColumn(name, F.lead(date).over(inside)), ahead, [*keys, "day_block"]).select(
        *df.columns, F.coalesce(name, "block_ahead").alias(name))


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], date: str = "date",
              by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the last right values on or before its date.

    The right side (one row per key and date) is stretched over the days each row
    stays current, up to the last date of its key; left rows after that take the
    latest values. The left side, which may be large and skewed, is read once,
    needs equi-joins only and is never ordered.
    """
    keys = list(by)
    known = with_next_date(one_row_per(right, [*keys, date]).select(*keys, date, *values), "following", date, keys)
    until = F.coalesce(F.date_sub("following", 1), F.col(date))
    stretched = known.select(
        *keys, F.explode(F.sequence(F.col(date), until, F.expr("interval 1 day"))).alias(date), *values)
    # One era holds all dates: without keys the latest values are a single row.
    era = F.floor(_block(date) / BLOCK_DAYS)
    latest = known.withColumn("era", era).where(F.col("following").isNull()).select(
        *keys, "era", F.struct(F.col(date).alias("last_day"), *values).alias("latest"))
    joined = left.join(stretched, [*keys, date], "left").withColumn("era", era).join(
        latest if keys else F.broadcast(latest), [*keys, "era"], "left")
    return joined.withColumns({
        v: F.when(F.col(date) > F.col("latest.last_day"), F.col("latest")[v]).otherwise(F.col(v)) for v in values
    }).select(*left.columns, *values)
