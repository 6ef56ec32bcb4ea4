"""Activity and sentiment beside a daily series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.activity import daily_counts, mean_by
from pulse.operators.joins import one_row_per
from pulse.operators.series import align_on_first, calendar_of, daily_panel, gap_filled


def market_series(first: DataFrame, *others: DataFrame, start: dt.date | None = None) -> DataFrame:
    """Several daily series on every calendar day, closed days filled forward.

    Days before ``start`` only seed the fill and are left out of the result.
    """
    aligned = align_on_first(first, *others)
    values = [c for c in aligned.columns if c != "date"]
    return gap_filled(aligned, values, calendar_of(aligned), start)


def group_beside_series(comments: DataFrame, comment_time: Column, posts: DataFrame,
                        post_time: Column, series: DataFrame) -> DataFrame:
    """Daily comments and posts of a group next to the series."""
    return daily_panel(
        daily_counts(comments, comment_time, "comment_count"),
        daily_counts(posts, post_time, "submission_count"),
        series, ("comment_count", "submission_count"),
    )


def enriched_daily(activity: DataFrame, time: Column, series: DataFrame,
                   only: Column | None = None) -> DataFrame:
    """Daily activity with the series value of the day, optionally of flagged rows only.

    A day has one series value, so the average over its rows is that value:
    rows are counted first and only the daily totals are joined.
    """
    rows = activity if only is None else activity.filter(only)
    return daily_counts(rows, time, "comment_count").join(
        one_row_per(series, ["date"]), ["date"], "left"
    )


def sentiment_daily(classified: DataFrame, time: Column, label: str, means: Mapping[str, Column],
                    series: DataFrame) -> DataFrame:
    """Count and averages per (day, class) beside the series; rows without class dropped."""
    daily = mean_by(
        classified.filter(F.col(label) != "").withColumn("date", F.to_date(time)),
        means, ["date", label], "comment_count",
    )
    return daily.join(one_row_per(series, ["date"]), ["date"], "left")


def present(df: DataFrame, names: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Report column names in place of working names."""
    return df.withColumnsRenamed(dict(names)).select(*[names.get(c, c) for c in order])
