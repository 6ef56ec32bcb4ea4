"""Equi-joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
_SALT = "join_salt"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, so a group without a key keeps its rows."""
    names = {c: f"right_{c}" for c in on}
    meets = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    joined = left.join(right.withColumnsRenamed(names), meets, how)
    return joined.drop(*names.values())


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS, null_safe: bool = False) -> DataFrame:
    """Join with each key split over ``salts`` partitions.

    The left side, which may be skewed, gets a salt from the ``spread`` columns
    (an id, so the salt is the same after any retry). Every right row is copied
    once per salt. Each left row meets each matching right row exactly once, so
    inner, left, left_semi and left_anti joins keep their results. Should the
    right side turn out small, adaptive execution still broadcasts it.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot copy its right side")
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted, copied = left.withColumn(_SALT, salt), right.withColumn(_SALT, copies)
    if null_safe:
        joined = null_safe_join(salted, copied, [*on, _SALT], how)
    else:
        joined = salted.join(copied, [*on, _SALT], how)
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    return joined.select(*left.columns, *added)


def one_row_per(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rows through, failing the query when a key occurs twice."""
    values = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in values])
    checked = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"duplicate {', '.join(keys)}"))
    ).otherwise(F.first(row))
    return df.groupBy(*keys).agg(checked.alias("only")).select(*keys, "only.*").select(df.columns)
