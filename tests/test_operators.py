import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulse.operators import activity, cleaning, joins, quantiles, sampling, scaling, series
from pulse.sources import readers, sinks

D = dt.date
SLOW = settings(max_examples=6, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


# ---- cleaning --------------------------------------------------------------------------

def test_clean_comments_drops_tombstones_markup_and_notice(spark):
    from pulse.functions.text import SHORT_POST_NOTICE
    bodies = [None, "", "[removed]", "[deleted]", "![img](emote|t5_2th52|4271)", SHORT_POST_NOTICE,
              "keep", "up ![img](emote|t5_2th52|1)"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [r.body for r in cleaning.clean_comments(df).collect()] == ["keep", "up "]


def test_missing_profile_and_pruning(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "None", "z"), (4, "v", "w")],
                               "id int, a string, b string")
    assert rows(cleaning.missing_profile(df)) == [
        ("a", 3, 4, 0.75), ("b", 1, 4, 0.25), ("id", 0, 4, 0.0)]
    assert cleaning.prune_sparse(df, 0.5).columns == ["id", "b"]


def test_split_leaves_null_in_neither(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    yes, no = cleaning.split_by(df, F.col("f"))
    assert (yes.count(), no.count()) == (1, 1)


def test_drop_matching(spark):
    df = spark.createDataFrame([("a bot here",), ("fine",), (None,)], "body string")
    assert [r.body for r in cleaning.drop_matching(df, "body", ["bot", "x|y"]).collect()] == ["fine"]


# ---- activity --------------------------------------------------------------------------

def test_top_n_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "g string")
    assert [tuple(r) for r in activity.top_n(df, "g", 2).collect()] == [("a", 2), ("b", 2)]


def test_ranked_panel_pads_the_shorter_side(spark, rows):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "g string, f boolean")
    assert rows(activity.ranked_panel(df, "g", "f", 5, ("off", "on"))) == [(1, "b", "a"), (2, "c", None)]


def test_grain_totals_agree(spark):
    start = dt.datetime(2021, 11, 28)
    rng = random.Random(5)
    df = spark.createDataFrame(
        [(start + dt.timedelta(minutes=rng.randrange(60 * 24 * 60)), rng.random() < 0.3) for _ in range(500)],
        "t timestamp_ntz, f boolean")
    grains = activity.activity_by_grain(df, F.col("t"), 2021)
    totals = {r.grain: r.n for r in grains.groupBy("grain").agg(F.sum("n").alias("n")).collect()}
    in_2021 = df.filter(F.year("t") == 2021).count()
    assert totals == {"month": in_2021, "date": 500, "hour": 500}
    week = activity.activity_by_weekday(df, F.col("t"), F.col("f"))
    assert all(r.n_all == r.n_flagged + r.n_unflagged for r in week.collect())
    assert week.agg(F.sum("n_all")).first()[0] == 500


def test_null_times_do_not_mix_into_grains(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, 0),), (None,)], "t timestamp_ntz")
    assert activity.activity_by_grain(df, F.col("t"), 2021).count() == 3


def test_activity_vs_size_counts_like_distinct(spark, rows):
    df = spark.createDataFrame([("g", "u", "t"), ("g", "u", None), ("g", None, "t"), ("h", "v", "t")],
                               "g string, a string, i string")
    assert rows(activity.activity_vs_size(df, "g", "a", "i", 0, 0)) == [
        ("g", 1, 2, 2.0), ("h", 1, 1, 1.0)]
    approx = activity.activity_vs_size(df, "g", "a", "i", 0, 0, approx=True)
    assert rows(approx) == [("g", 1, 2, 2.0), ("h", 1, 1, 1.0)]


def test_hot_group_survives_semi_join(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i}") for i in range(300)], "id int, g string")
    kept = activity.in_large_groups(df, "g", 10, ["id"])
    assert kept.columns == ["id", "g"] and kept.count() == 200


# ---- joins -----------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, rows, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(90)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k0", 3), ("zz", 4)], "k string, v int")
    plain = left.join(right, ["k"], how)
    salted = joins.salted_join(left, right, ["k"], ["id"], how).select(plain.columns)
    assert rows(salted) == rows(plain)


def test_salted_join_refuses_joins_that_keep_the_right_side(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        joins.salted_join(df, df, ["id"], ["id"], "full_outer")


def test_duplicate_key_fails(spark):
    df = spark.createDataFrame([(D(2021, 1, 1), 1.0), (D(2021, 1, 1), 2.0)], "date date, v double")
    with pytest.raises(Exception, match="duplicate date"):
        joins.one_row_per(df, ["date"]).collect()


def test_null_keys_meet(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 9)], "k string, w int")
    assert rows(joins.null_safe_join(left, right, ["k"])) == [(None, 1, 9)]


# ---- series ----------------------------------------------------------------------------

def test_gap_at_the_start_stays_null_and_at_the_end_is_filled(spark):
    values = spark.createDataFrame([(D(2021, 1, 2), 5.0), (D(2021, 1, 4), None)], "date date, v double")
    days = series.calendar(spark, D(2021, 1, 1), D(2021, 1, 5))
    filled = series.gap_filled(values, ["v"], days).orderBy("date")
    assert [r.v for r in filled.collect()] == [None, 5.0, 5.0, 5.0, 5.0]
    assert [r.v for r in series.forward_fill(filled, "date", ["v"]).orderBy("date").collect()] == [
        None, 5.0, 5.0, 5.0, 5.0]  # a second fill changes nothing
    kept = series.gap_filled(values, ["v"], days, D(2021, 1, 2))
    assert kept.count() == 4


def test_calendar_has_both_ends(spark):
    assert series.calendar(spark, D(2021, 1, 1), D(2022, 8, 31)).count() == 608


def test_panel_joins_on_date_not_position(spark, rows):
    a = spark.createDataFrame([(D(2021, 1, 1), 3), (D(2021, 1, 3), 4)], "date date, a int")
    b = spark.createDataFrame([(D(2021, 1, 3), 7)], "date date, b int")
    s = spark.createDataFrame([(D(2021, 1, 1), 1.0)], "date date, v double")
    assert rows(series.daily_panel(a, b, s, ("a", "b"))) == [
        (D(2021, 1, 1), 3, 0, 1.0), (D(2021, 1, 3), 4, 7, None)]


@SLOW
@given(st.data())
def test_asof_join_matches_brute_force(spark, data):
    day = st.integers(0, 20)
    right = data.draw(st.dictionaries(st.tuples(st.sampled_from("ab"), day), st.integers(0, 9), max_size=8))
    left = data.draw(st.lists(st.tuples(st.sampled_from("abc"), day), min_size=1, max_size=12))
    zero = D(2021, 1, 1)
    ldf = spark.createDataFrame(
        [(i, k, zero + dt.timedelta(d)) for i, (k, d) in enumerate(left)], "id int, k string, date date")
    rdf = spark.createDataFrame(
        [(k, zero + dt.timedelta(d), v) for (k, d), v in right.items()], "k string, date date, v int")
    got = {r.id: r.v for r in series.asof_join(ldf, rdf, ["v"], by=["k"]).collect()}
    for i, (k, d) in enumerate(left):
        known = [(rd, v) for (rk, rd), v in right.items() if rk == k and rd <= d]
        assert got[i] == (max(known)[1] if known else None)
    assert len(got) == len(left)


# ---- quantiles and scaling -------------------------------------------------------------

@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-50, 50)), min_size=1, max_size=60),
       st.sampled_from([1, 3, 100_000]))
def test_exact_quantiles_match_brute_force(spark, pairs, rows_per_range):
    df = spark.createDataFrame(pairs, "g string, v int")
    probs = {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p100": 1.0}
    got = {r.g: r for r in quantiles.exact_quantiles(df, "v", probs, ["g"], rows_per_range).collect()}
    for g in {g for g, _ in pairs}:
        values = sorted(v for k, v in pairs if k == g)
        for name, p in probs.items():
            place = p * (len(values) - 1)
            low = int(place)
            high = min(low + 1, len(values) - 1)
            assert got[g][name] == pytest.approx(values[low] + (values[high] - values[low]) * (place - low))


def test_one_value_holds_most_rows(spark):
    df = spark.createDataFrame([(7,)] * 500 + [(i,) for i in range(20)], "v int")
    row = quantiles.exact_quantiles(df, "v", {"m": 0.5, "q99": 0.99}).first()
    expected = statistics.quantiles([7] * 500 + list(range(20)), n=100, method="inclusive")
    assert (row.m, row.q99) == pytest.approx((expected[49], expected[98]))


def test_many_ranges_give_the_same_quantiles(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(3000)).cast("int").alias("v"))
    probs = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 0.999}
    results = [tuple(quantiles.exact_quantiles(df, "v", probs, rows_per_range=n).first())
               for n in (1, 40, 10**6)]
    builtin = df.agg(*[F.percentile("v", p) for p in probs.values()]).first()
    assert results[0] == results[1] == results[2] == pytest.approx(tuple(builtin))


def test_quantile_report_takes_every_figure_from_its_own_column(spark):
    df = spark.createDataFrame([(2021, i, 1000 - i) for i in range(101)], "year int, a int, b int")
    report = {r.feature_name: r for r in quantiles.quantile_report(df, ["a", "b"], "year").collect()}
    assert (report["a"]["q99"], report["a"]["max"], report["a"]["mean"]) == (99.0, 100.0, 50.0)
    assert (report["b"]["min"], report["b"]["median"], report["b"]["max"]) == (900.0, 950.0, 1000.0)


def test_minmax_scale(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 4), ("a", 3.0, 4), ("b", 5.0, 4), ("b", None, 4)],
                               "g string, x double, c int")
    assert rows(scaling.minmax_scale(df, ["x", "c"])) == [
        ("a", 0.0, 0.0), ("a", 0.5, 0.0), ("b", 1.0, 0.0), ("b", None, 0.0)]
    assert rows(scaling.minmax_scale(df, ["x"], ["g"]).select("g", "x")) == [
        ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", None)]


# ---- sampling --------------------------------------------------------------------------

def test_balance_keeps_the_smaller_class_whole(spark):
    df = spark.range(3000).withColumn("rare", F.col("id") % 10 == 0)
    counts = {r.rare: r["count"] for r in sampling.balance(df, "rare", "id").groupBy("rare").count().collect()}
    assert counts[True] == 300 and 230 < counts[False] < 370


def test_balance_of_one_class_keeps_nothing(spark):
    df = spark.range(10).withColumn("rare", F.lit(True))
    assert sampling.balance(df, "rare", "id").count() == 0


def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(2000)
    parts = sampling.hash_split(df, [0.8, 0.18, 0.02], "id")
    again = sampling.hash_split(df.repartition(7), [0.8, 0.18, 0.02], "id")
    ids = [{r.id for r in p.collect()} for p in parts]
    assert [{r.id for r in p.collect()} for p in again] == ids
    assert sum(map(len, ids)) == 2000 and len(set.union(*ids)) == 2000
    assert 1500 < len(ids[0]) < 1700


def test_sample_to_match(spark):
    n = sampling.sample_to_match(spark.range(4000), spark.range(1000), "id").count()
    assert 900 < n < 1100


def test_stack_tagged_fills_missing_columns(spark, rows):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([("q",)], "y string")
    assert rows(sampling.stack_tagged({"a": a, "b": b}, "tag")) == [("a", 1, None), ("b", None, "q")]


# ---- sources and sinks -----------------------------------------------------------------

def test_csv_keeps_quotes_breaks_and_spaces(spark, tmp_path, rows):
    data = [(1, 'say "hi", then\nleave'), (2, "  padded  "), (3, "plain")]
    df = spark.createDataFrame(data, "id int, body string")
    sinks.export_csv(df, ["id", "body"], str(tmp_path / "out"))
    assert rows(readers.load_csv(spark, str(tmp_path / "out"), df.schema, header=True)) == data


def test_new_stage_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.stage_new(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.stage_new(spark.range(3), path)
    assert sinks.stage(spark.range(5), path).count() == 5


def test_partitioned_stage_keeps_columns_and_order(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).cast("int").alias("year"), "id")
    staged = sinks.stage(df, str(tmp_path / "t"), ["year"])
    assert staged.columns == ["year", "id"] and staged.filter("year = 1").count() == 3


def test_series_file(spark, tmp_path, rows):
    path = tmp_path / "s.csv"
    path.write_text(",date,sp500,nasdaq,dj\n1,2021-01-01,1.5,2.5,3.5\n")
    assert rows(readers.load_series(spark, str(path))) == [(D(2021, 1, 1), 1.5, 2.5, 3.5)]


def test_cached_scope_always_lets_go(spark):
    df = spark.range(5)
    with pytest.raises(RuntimeError):
        with sinks.cached(df):
            assert df.is_cached
            raise RuntimeError
    assert not df.is_cached


def test_inventory_counts_rows_per_file(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    found = readers.file_inventory(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(found) == 2 and sum(r.n_rows for r in found) == 10
