"""Mergeable distinct counts."""

import pytest
from pyspark.sql import functions as F

from pulse.operators import sketches


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "rare").otherwise("often").alias("g"),
        F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("date"),
        F.when(F.col("id") % 100 == 7, None).otherwise((F.col("id") * 7919) % 23_003).alias("author"))


def test_merged_estimates_do_not_depend_on_the_way(events):
    daily = sketches.sketched(events, ["g", "date"], "author")
    got = {(r.grain, r.g, r.start): (r.n, r.n_different) for r in sketches.distinct_by_grain(daily, "date", "g").collect()}
    for grain, start in (("month", F.trunc("date", "month")), ("year", F.trunc("date", "year")), ("all", F.lit(None).cast("date"))):
        rows = events.withColumn("start", start)
        exact = rows.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("d")).collect()
        direct = {(r.g, r.start): r.n_different for r in sketches.estimated(
            sketches.merged(daily.withColumn("start", start), ["g", "start"])).collect()}
        once = {(r.g, r.start): r.n_different for r in sketches.estimated(
            sketches.sketched(rows, ["g", "start"], "author")).collect()}
        for r in exact:
            n, different = got[grain, r.g, r.start]
            assert n == r.n and different == direct[r.g, r.start]
            assert different == pytest.approx(r.d, rel=0.03) and once[r.g, r.start] == pytest.approx(r.d, rel=0.03)


def test_days_are_added_without_the_old_rows(events):
    first, later = (sketches.sketched(events.where(c), ["g", "date"], "author") for c in ("date < '2021-06-01'", "date >= '2021-06-01'"))
    both = sketches.estimated(sketches.merged(first.union(later), ["g"])).collect()
    daily = sketches.sketched(events, ["g", "date"], "author")
    whole = sketches.estimated(sketches.merged(daily, ["g"])).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, whole))
