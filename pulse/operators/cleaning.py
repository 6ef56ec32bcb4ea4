"""Missing-value profiles, pruning and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.text import EMOTE_MARKUP, SHORT_POST_NOTICE, strip_markup
from pulse.functions.values import DELETED, REMOVED, flag_int, is_missing, kept_text


def flags_to_int(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Boolean columns as 0/1, NULL kept, in one projection."""
    return df.withColumns({c: flag_int(F.col(c)) for c in columns})


def missing_counts(df: DataFrame, substring: bool = False) -> DataFrame:
    """One row: the missing values of every column, counted in a single pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.count_if(is_missing(F.col(f.name), f.dataType, substring)).alias(f.name)
            for f in df.schema.fields
        ],
    )


def missing_profile(df: DataFrame, substring: bool = False) -> DataFrame:
    """As :func:`missing_counts`, one row per column with its missing share."""
    counts = missing_counts(df, substring)
    return counts.unpivot("n_rows", df.columns, "column_name", "n_missing").select(
        "column_name", "n_missing", "n_rows",
        (F.col("n_missing") / F.col("n_rows")).alias("missing_share"),
    )


def sparse_columns(df: DataFrame, max_share: float) -> list[str]:
    """Columns whose missing share exceeds a bound. Brings one row to the driver."""
    row = missing_counts(df).first()
    return [c for c in df.columns if row["n_rows"] and row[c] / row["n_rows"] > max_share]


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column whose expression runs once per row however often it is used.

    The optimiser copies the expression of a plain column into every filter and
    projection above it. A one-element generator stands in the way of that,
    which pays for expensive expressions such as cleaned tokens.
    """
    return df.select("*", F.explode_outer(F.array(expression)).alias(name))


def prune(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def prune_sparse(df: DataFrame, max_share: float) -> DataFrame:
    return prune(df, sparse_columns(df, max_share))


def shape(df: DataFrame, name: str) -> DataFrame:
    """Row and column count of a table as a one-row report."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def drop_tombstones(df: DataFrame, body: str, markers: Sequence[str] = (REMOVED, DELETED, "")) -> DataFrame:
    """Drop removed, deleted and empty texts; NULL texts go as well."""
    return df.filter(kept_text(F.col(body), markers))


def drop_exact(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.col(column) != text)


def drop_matching(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    """Drop rows whose text matches any pattern, with one scan of the text."""
    return df.filter(~F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def split_by(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the flag holds and rows where it does not; NULL is in neither."""
    return df.filter(flag), df.filter(~flag)


def clean_comments(df: DataFrame, body: str = "body", markup: str = EMOTE_MARKUP,
                   notice: str = SHORT_POST_NOTICE) -> DataFrame:
    """Drop tombstones, strip emote markup, then drop empty texts and the notice."""
    kept = drop_tombstones(df, body, (REMOVED, DELETED))
    stripped = kept.withColumn(body, strip_markup(F.col(body), markup))
    return drop_exact(stripped.filter(F.col(body) != ""), body, notice)
