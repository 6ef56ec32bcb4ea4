"""Scans of parquet and CSV, local lookups, views and a file inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.sources.schema import SERIES_FILE
from pulse.sources.sinks import CSV_NULL

#: Bytes of one default split of a scan.
SMALL_SCAN = 128 * 1024 * 1024


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet scan with a declared schema, so no footer is read to plan it."""
    return spark.read.schema(schema).parquet(path)


def load_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = False,
             multiline: bool = True) -> DataFrame:
    """CSV scan for files written by :func:`pulse.sources.sinks.export_csv`.

    Text with line breaks needs ``multiline``, which reads each file in one
    task; the exporter therefore bounds the rows per file.
    """
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", CSV_NULL)
        .option("emptyValue", "")
        .csv(path)
    )


def load_series(spark: SparkSession, path: str, schema: T.StructType = SERIES_FILE,
                index_column: str = "row_index", date_column: str = "date",
                rename: str = "d") -> DataFrame:
    """A daily series from CSV: index column dropped, date typed and renamed."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.drop(index_column).withColumn(
        date_column, F.to_date(date_column, "yyyy-MM-dd")
    ).withColumnRenamed(date_column, rename)


def local_lookup(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small typed table from literals, for lexicons and code lists."""
    return spark.createDataFrame(list(rows), schema)


def register(df: DataFrame, name: str) -> DataFrame:
    """Name a DataFrame for use in SQL text."""
    df.createOrReplaceTempView(name)
    return df


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows held by each file behind a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than the session has cores.

    One large row group is one task, which starves CPU-heavy text work on small
    inputs. Only scans below one default split are dealt out, whatever the number
    of cores, so on a large table no row is ever moved.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(size) < SMALL_SCAN and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if small else df
