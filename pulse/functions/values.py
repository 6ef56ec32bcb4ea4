"""Conditional values, sentinels and missing-value predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentinels of the archive.
DELETED = "[deleted]"
REMOVED = "[removed]"
UNKNOWN = "unknown"
MISSING_WORDS = ("None", "NULL")


def flag_int(flag: Column) -> Column:
    """true/false/NULL to 1/0/NULL."""
    return flag.cast("int")


def blank_to_unknown(text: Column) -> Column:
    return F.when(text == "", UNKNOWN).otherwise(text)


def is_edited(edited: Column) -> Column:
    """The archive stores "false" or an edit time; NULL counts as edited."""
    return F.when(edited == "false", False).otherwise(True)


def has_award(gilded: Column) -> Column:
    """false for 0, true from 1 on, NULL for anything else."""
    return F.when(gilded == 0, False).when(gilded >= 1, True)


def account_deleted(author: Column) -> Column:
    return F.when(author == DELETED, 1).otherwise(0)


def is_missing(column: Column, kind: T.DataType, substring: bool = False) -> Column:
    """Whether a value counts as missing; the rule follows the column type.

    Text: NULL, empty, 'None' or 'NULL' (``substring=True`` also counts longer
    texts that contain those words). Floating point: NULL or NaN. Others: NULL.
    """
    if isinstance(kind, T.StringType):
        if substring:
            words: Column = column.contains(MISSING_WORDS[0])
            for word in MISSING_WORDS[1:]:
                words = words | column.contains(word)
        else:
            words = column.isin(*MISSING_WORDS)
        return column.isNull() | (column == "") | words
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def kept_text(body: Column, markers: Sequence[str] = (REMOVED, DELETED, "")) -> Column:
    """False for tombstones; NULL stays NULL, so a filter drops it."""
    return ~body.isin(*markers)
