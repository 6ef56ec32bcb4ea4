"""Unions, repeatable samples, class balancing and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.hashing import unit_hash


def stack(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def stack_tagged(reports: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Reports with different columns below each other, each with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in reports.items()]
    result = tagged[0]
    for frame in tagged[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result.select(tag, *[c for c in result.columns if c != tag])


def hash_sample(df: DataFrame, key: str, fraction: float | Column, seed: int = 0) -> DataFrame:
    """Bernoulli sample decided by the key: the same rows on every run. Rows without a key are never drawn."""
    return _drawn(df, key, fraction, seed, "sample")


def _drawn(df: DataFrame, key: str, fraction: float | Column, seed: int, stream: str) -> DataFrame:
    return df.filter(unit_hash(F.col(key), seed, stream) < fraction)


def random_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Spark's own sample, which depends on the partitioning of its input."""
    return df.sample(fraction=fraction, seed=seed)


def sample_to_match(df: DataFrame, wanted: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Sample about as many rows as another frame holds."""
    ratio = wanted.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar() / df.agg(
        F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n")
    ).scalar()
    return hash_sample(df, key, ratio, seed)


def balance(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Keep the smaller class and sample the larger one down to about its size.

    ``label`` is a boolean; NULL labels and rows without a key are dropped. One
    pass over the label column counts both classes, a second one filters:
    nothing is joined.
    """
    flag = F.col(label)
    shares = df.filter(F.col(key).isNotNull()).agg(F.count_if(flag).alias("yes"), F.count_if(~flag).alias("no")).select(F.struct(
        (F.least("yes", "no") / F.nullif(F.col("yes"), F.lit(0))).alias("yes"),
        (F.least("yes", "no") / F.nullif(F.col("no"), F.lit(0))).alias("no"),
    )).scalar()
    fraction = F.when(flag, shares["yes"]).when(~flag, shares["no"])
    return _drawn(df, key, fraction, seed, "balance")


def part_number(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The number of the split a key belongs to, by weight; rows without a key are in the last one."""
    total = float(sum(weights))
    place = unit_hash(key, seed, "split")
    part = F.lit(len(weights) - 1)
    for number, edge in reversed(list(enumerate(accumulate(weights[:-1])))):
        part = F.when(place < edge / total, number).otherwise(part)
    return part


def hash_split(df: DataFrame, weights: Sequence[float], key: str, seed: int = 0) -> list[DataFrame]:
    """Disjoint, complete splits decided by the key."""
    numbered = df.withColumn("part", part_number(F.col(key), weights, seed))
    return [numbered.filter(F.col("part") == i).drop("part") for i in range(len(weights))]


def random_split(df: DataFrame, weights: Sequence[float], seed: int) -> list[DataFrame]:
    """Spark's own split, which depends on the partitioning of its input."""
    return df.randomSplit(list(weights), seed)
