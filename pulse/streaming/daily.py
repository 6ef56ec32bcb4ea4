"""Daily counts and keyword rates as new files arrive.

The same figures as the batch jobs for finished days: a day is written once, when
the watermark has passed it, so the state holds only the days still open. The
latest day stays open until rows of a later one arrive, and rows that come more
than ``delay`` after their day are not counted; the batch jobs count both.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: T.StructType,
             files_per_batch: int = 1000) -> DataFrame:
    """A parquet folder as a stream of its new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_rates(stream: DataFrame, time: Column, flags: Mapping[str, Column] | None = None,
                delay: str = "1 day") -> DataFrame:
    """Rows per day, and the share of rows where each flag holds.

    ``time`` must be a timestamp without zone (see ``functions.timefx``); rows
    later than ``delay`` are not counted.
    """
    named = dict(flags or {})
    # The start of the calendar day as seconds since 1970: no step looks at the session zone.
    day = F.timestamp_seconds(F.unix_date(F.to_date(time)) * 86_400)
    rows = stream.select(
        day.alias("event_time"), *[f.alias(n) for n, f in named.items()]
    ).withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", "1 day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(n).cast("int")).alias(n) for n in named]
    ).select(
        F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int")).alias("date"), "n", *named)


def keep_table(daily: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished days to a parquet table, catching up with what is there and stopping."""
    return daily.writeStream.outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", checkpoint
    ).format("parquet").start(path)
