"""As-of joins over long series."""

import datetime as dt
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from pulse.operators import series

DAY = dt.date(1700, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("by", [(), ("k",)])
def test_next_dates_cross_blocks(spark, by):
    rng = random.Random(4)
    rows = {(k, day(rng.randrange(n))) for k, n in (("a", 40), ("b", 6_000), ("c", 90_000), (None, 9_000)) for _ in range(60)}
    if not by:
        rows = {(None, d) for _, d in rows}
    df = spark.createDataFrame(sorted(rows, key=str), "k string, date date")
    got = {(r.k, r.date): r.following for r in series.with_next_date(df, "following", by=by).collect()}
    for k in {k for k, _ in rows}:
        dates = sorted(d for other, d in rows if other == k)
        assert [got[k, d] for d in dates] == [*dates[1:], None]


def test_a_key_of_a_hundred_thousand_dates(spark):
    known = spark.range(100_000).select(
        F.lit("a").alias("k"), F.date_add(F.lit(DAY), (F.col("id") * 3).cast("int")).alias("date"), F.col("id").alias("v"))
    left = spark.range(2_000).select(
        "id", F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("k"),
        F.date_add(F.lit(DAY), ((F.col("id") * 7919) % 310_000 - 500).cast("int")).alias("date"))
    got = series.asof_join(left, known, ["v"], by=["k"])
    dates = [day(3 * i) for i in range(100_000)]
    for r in got.collect():
        place = bisect_right(dates, r.date) - 1
        assert r.v == (place if place >= 0 and r.k == "a" else None)


@pytest.mark.parametrize("by", [(), ("k",)])
def test_plan_gathers_no_series(spark, by):
    known = spark.range(50).select(F.lit("a").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), "id")
    left = spark.range(9).select(F.lit("a").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"),
                                 F.col("id").alias("row"))
    known = known if by else known.drop("k")
    plan = series.asof_join(left, known, ["id"], by=by)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan and "NestedLoop" not in plan


def test_empty_sides_and_missing_dates(spark, rows):
    known = spark.createDataFrame([("a", day(5), 1)], "k string, date date, v int")
    left = spark.createDataFrame([(1, "a", day(4)), (2, "a", None), (3, None, day(9)), (4, "a", day(5000)), (5, "a", day(5))],
                                 "id int, k string, date date")
    assert rows(series.asof_join(left, known, ["v"], by=["k"]).select("id", "v")) == [
        (1, None), (2, None), (3, None), (4, 1), (5, 1)]
    assert rows(series.asof_join(left, known.limit(0), ["v"], by=["k"]).select("id", "v")) == [
        (i, None) for i in range(1, 6)]
    assert series.asof_join(left.limit(0), known, ["v"], by=["k"]).count() == 0
