"""Cases that no table of the fixture holds."""

import datetime as dt
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulse.operators import quantiles, ranking, sampling, scaling
from pulse.sources.readers import load_csv
from pulse.sources.sinks import export_csv
from pulse.streaming.daily import arriving, daily_rates, keep_table


@pytest.mark.parametrize("seed", [0, 7])
def test_a_split_keeps_the_class_ratio_of_a_balanced_set(spark, seed):
    rows = spark.range(6000).withColumn("rare", F.col("id") % 10 == 0)
    balanced = sampling.balance(rows, "rare", "id", seed)
    for part, share in zip(sampling.hash_split(balanced, [0.6, 0.2, 0.2], "id", seed), (0.6, 0.2, 0.2), strict=True):
        sizes = {r.rare: r["count"] for r in part.groupBy("rare").count().collect()}
        assert sizes[True] == pytest.approx(600 * share, abs=45)
        assert sizes[False] == pytest.approx(600 * share, abs=70)


def test_rows_without_a_key_are_never_drawn(spark):
    rows = spark.createDataFrame([(None,)] * 50 + [(i,) for i in range(50)], "id long")
    for seed in range(3):
        assert sampling.hash_sample(rows, "id", 0.99, seed).filter("id is null").count() == 0
    assert sampling.hash_split(rows, [0.5, 0.5], "id")[1].filter("id is null").count() == 50


def test_csv_tells_empty_text_from_null(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, 'a "b"\nc'), (4, " x "), (5, "None")]
    df = spark.createDataFrame(rows, "id long, body string")
    for header in (True, False):
        path = export_csv(df, ["id", "body"], str(tmp_path / f"csv{header}"), header)
        assert sorted(map(tuple, load_csv(spark, path, df.schema, header).collect())) == rows


def test_groups_with_null_values_only_keep_a_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, x double")
    got = {r.g: r.mid for r in quantiles.exact_quantiles(df, "x", {"mid": 0.5}, ["g"]).collect()}
    assert got == {"a": 2.0, "b": None, None: 5.0}
    report = {r.g: (r.min, r.median, r["mean"]) for r in quantiles.quantile_report(df, ["x"], "g").collect()}
    assert report == {"a": (1.0, 2.0, 2.0), "b": (None, None, None), None: (5.0, 5.0, 5.0)}


def test_nan_takes_no_part_in_a_range(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 4.0), (3, math.nan), (4, None)], "id int, x double")
    got = {r.id: r.x for r in scaling.minmax_scale(df, ["x"]).collect()}
    assert (got[1], got[2], got[4]) == (0.0, 1.0, None) and math.isnan(got[3])


def test_streamed_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(dt.datetime(2021, 3, 5, 12), "x"), (dt.datetime(2021, 3, 9, 1), "y")]
    spark.createDataFrame(rows, "t timestamp_ntz, body string").write.parquet(source)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = arriving(spark, source, spark.read.parquet(source).schema)
        keep_table(daily_rates(stream, F.col("t")), out, str(tmp_path / "c")).awaitTermination(120)
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(dt.date(2021, 3, 5), 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_numbers_and_carried_values_cross_ranges(spark):
    rows = [(i, i if i % 50 == 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(7)
    numbers = {r.id: r.place for r in ranking.numbered(df, [F.desc("id")], "place").collect()}
    assert numbers == {i: 399 - i for i in range(400)}
    wanted, last = defaultdict(lambda: None), None
    for i, x in rows:
        last = x if x is not None else last
        wanted[i] = last
    filled = {r.id: r.x for r in ranking.carried_forward(df, F.col("id"), ["x"]).collect()}
    assert filled == dict(wanted)
