"""Data quality, pruning, time features and export of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.timefx import calendar_parts
from pulse.functions.values import account_deleted
from pulse.operators.cleaning import flags_to_int, missing_profile, prune_sparse
from pulse.sources.readers import load_csv
from pulse.sources.schema import struct_of
from pulse.sources.sinks import export_csv, stage


def quality_profile(df: DataFrame, flags: Sequence[str] = ()) -> DataFrame:
    """Missing values per column of a wide table, flags read as numbers."""
    return missing_profile(flags_to_int(df, flags))


def prune_and_stage(df: DataFrame, path: str, max_missing: float,
                    partition_by: Sequence[str] = ()) -> DataFrame:
    """Drop sparse columns and write the clean table."""
    return stage(prune_sparse(df, max_missing), path, partition_by)


def time_features(df: DataFrame, time: Column, author: str | None = None) -> DataFrame:
    """Calendar columns of an event time, and whether its account is gone."""
    parts = calendar_parts(time)
    if author is not None:
        parts["account_deleted"] = account_deleted(F.col(author))
    return df.withColumns(parts)


def csv_round_trip(df: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    """Export columns to CSV and read them back with their declared types."""
    export_csv(df, columns, path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return load_csv(
        df.sparkSession, path, struct_of(**{c: kinds[c] for c in columns}), header=True
    )
