"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import scratch_path

#: The words of every contract: runs of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The columns of a document, in order.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder once and read it from there.

    Later readers, and tasks repeated after the loss of an executor, take it
    from the files instead of computing it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw(column: str = "text") -> Column:
    """UTF-8 bytes of a text, which need no decoding on the Python side."""
    return F.col(column).cast("binary").alias(column)


def replaced_text(df: DataFrame, text: Column) -> DataFrame:
    """The same columns in the same order, with another text and its length."""
    changed = df.withColumn("text", text)
    if "n_chars" in df.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))
    return changed


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
