"""Min-max scaling of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.joins import salted_join


def _scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(F.isnan(value), value.cast("double")).when(
        value.isNotNull(), F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low)))


def minmax_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 spread: Sequence[str] = ()) -> DataFrame:
    """Columns mapped to [0, 1] by their range; a constant column becomes 0.

    NaN takes no part in the range and stays NaN.

    The ranges are aggregated first (no window over whole groups). Overall they
    are one row, read back as a scalar subquery; per key they are joined back
    with hot keys split over ``spread``.
    """
    def number(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value)

    ends = df.groupBy(*by).agg(
        *[F.min(number(c)).alias(f"lo_{c}") for c in columns],
        *[F.max(number(c)).alias(f"hi_{c}") for c in columns],
    )
    if not by:
        row = ends.select(F.struct("*")).scalar()
        return df.withColumns({
            c: _scaled(F.col(c), row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns
        })
    joined = salted_join(df, ends, list(by), list(spread) or list(columns), "left",
                         null_safe=True)
    return joined.withColumns(
        {c: _scaled(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns}
    ).select(df.columns)
