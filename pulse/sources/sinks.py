"""Stages, exports, small reports and a caching scope."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame

ROWS_PER_CSV_FILE = 100_000
#: Marks NULL in exports, so that an empty text stays an empty text.
CSV_NULL = "\\N"


def stage(df: DataFrame, path: str, partition_by: Sequence[str] = (),
          mode: str = "overwrite") -> DataFrame:
    """Write a parquet stage and continue from the files.

    The written table cuts the lineage: a lost executor re-reads files instead
    of recomputing everything upstream. Partition by low-cardinality columns
    only (year, month), never by group or author; the rows are then rebalanced
    so that a folder gets few, evenly sized files however skewed it is.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def stage_new(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """As :func:`stage`, but fails when the table is already there."""
    return stage(df, path, partition_by, mode="errorifexists")


def bucketed_stage(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 200) -> DataFrame:
    """A stage dealt and sorted by keys: joins and groupings by these keys need no shuffle.

    Stages to be joined need the same number of buckets; choose it so that a bucket
    fits a task. A key with a large share of the rows fills a bucket: for such keys use a
    plain stage, whose joins Spark can split. The table is known to this session only.
    """
    name = f"stage_{uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name).select(df.columns)


def export_csv(df: DataFrame, columns: Sequence[str], path: str, header: bool = True) -> str:
    """Selected columns as quoted CSV that survives quotes and line breaks."""
    (
        df.select(*columns).write.mode("overwrite")
        .option("header", header)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", CSV_NULL)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", ROWS_PER_CSV_FILE)
        .csv(path)
    )
    return path


def report_csv(df: DataFrame, path: str) -> str:
    """One CSV file for a finished, aggregated report.

    ``coalesce(1)`` would pull the aggregation itself into one task;
    ``repartition(1)`` moves only its few result rows.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return path


@contextmanager
def cached(*frames: DataFrame) -> Iterator[None]:
    """Keep reused frames for the length of a block, then always let them go."""
    for frame in frames:
        frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        for frame in frames:
            frame.unpersist()
