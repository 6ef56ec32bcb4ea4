"""Calendar expressions that do not depend on the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def epoch_time(seconds: Column) -> Column:
    """Epoch seconds as a UTC timestamp without time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def calendar_parts(time: Column) -> dict[str, Column]:
    """date, year, month, day_of_week (1 = Sunday) and hour of a timestamp."""
    return {
        "date": F.to_date(time),
        "year": F.year(time),
        "month": F.month(time),
        "day_of_week": F.dayofweek(time),
        "hour": F.hour(time),
    }


def parse_day(text: Column) -> Column:
    """``yyyy-MM-dd`` text as a date."""
    return F.to_date(text, "yyyy-MM-dd")


def time_text(time: Column) -> Column:
    return F.date_format(time, TEXT_FORMAT)


def in_year(time: Column, year: int, epoch: bool = False) -> Column:
    """Rows of one year, written as a half-open range on the bare column.

    ``year(col) = y`` hides the column from the scan; a range reaches the
    parquet row-group statistics.
    """
    start, end = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    if epoch:
        zero = dt.datetime(1970, 1, 1)
        low, high = (F.lit(int((t - zero).total_seconds())) for t in (start, end))
    else:
        low, high = (F.lit(str(t)).cast("timestamp_ntz") for t in (start, end))
    return (time >= low) & (time < high)
