import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulse.functions import hashing, keywords, text, timefx, values


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("seconds, expected", [
    (0, dt.datetime(1970, 1, 1)),
    (1640995199, dt.datetime(2021, 12, 31, 23, 59, 59)),
    (1640995200, dt.datetime(2022, 1, 1)),
    (None, None),
])
def test_epoch_time_is_utc_whatever_the_session_zone(spark, seconds, expected):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert one(spark, seconds, timefx.epoch_time, "long") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_calendar_parts_count_weekdays_from_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3, 22, 5),)], "t timestamp_ntz")
    row = df.select(*[c.alias(n) for n, c in timefx.calendar_parts(F.col("t")).items()]).first()
    assert tuple(row) == (dt.date(2021, 1, 3), 2021, 1, 1, 22)


def test_in_year_takes_the_edges_of_a_year(spark):
    df = spark.createDataFrame([(1609459199,), (1609459200,), (1640995199,), (1640995200,)], "t long")
    kept = df.filter(timefx.in_year(F.col("t"), 2021, epoch=True)).collect()
    assert [r.t for r in kept] == [1609459200, 1640995199]


@pytest.mark.parametrize("flag, expected", [(True, 1), (False, 0), (None, None)])
def test_flag_int_keeps_null(spark, flag, expected):
    assert one(spark, flag, values.flag_int, "boolean") == expected


@pytest.mark.parametrize("edited, expected", [("false", False), ("1612137600", True), (None, True)])
def test_null_counts_as_edited(spark, edited, expected):
    assert one(spark, edited, values.is_edited) is expected


@pytest.mark.parametrize("gilded, expected", [(0, False), (1, True), (7, True), (-1, None), (None, None)])
def test_has_award(spark, gilded, expected):
    assert one(spark, gilded, values.has_award, "int") is expected


@pytest.mark.parametrize("word, strict, substring", [
    (None, True, True), ("", True, True), ("None", True, True), ("NULL", True, True),
    ("None of this", False, True), ("fine", False, False),
])
def test_missing_text_is_exact_unless_asked(spark, word, strict, substring):
    kind = spark.createDataFrame([], "x string").schema["x"].dataType
    assert one(spark, word, lambda c: values.is_missing(c, kind)) is strict
    assert one(spark, word, lambda c: values.is_missing(c, kind, substring=True)) is substring


def test_missing_number_rules(spark):
    df = spark.createDataFrame([(float("nan"), 0, False), (None, None, None)], "a double, b int, c boolean")
    result = df.select(*[values.is_missing(F.col(f.name), f.dataType) for f in df.schema.fields])
    assert [tuple(r) for r in result.collect()] == [(True, False, False), (True, True, True)]


@pytest.mark.parametrize("body, labor, yolo", [
    ("unemployment is up", True, False),      # hits the stem of its own
    ("Employed again", True, False),          # ignores case
    ("reemploy", False, False),               # a stem must begin a word
    ("all investors", False, True),           # prefix match of "all in"
    ("nothing here", False, False),
])
def test_keyword_stems(spark, body, labor, yolo):
    stems = keywords.KEYWORD_STEMS
    assert one(spark, body, lambda c: keywords.keyword_flag(c, stems["labor"])) is labor
    assert one(spark, body, lambda c: keywords.keyword_flag(c, stems["yolo"])) is yolo


def test_stem_outside_ascii_is_refused():
    with pytest.raises(ValueError):
        keywords.stem_pattern(["état"])


def test_character_flags(spark):
    flags = keywords.keyword_columns(F.col("x"))
    df = spark.createDataFrame([("e.g. $5...",), ("five..",)], "x string").withColumns(flags)
    assert [(r.dollar, r.ellipsis) for r in df.collect()] == [(True, True), (False, False)]


def test_topic_matches_inside_words(spark):
    assert one(spark, "Unmasked", keywords.topic_flag) is True
    assert one(spark, "weather", keywords.topic_flag) is False


def test_sentences_and_tokens(spark):
    assert one(spark, "One two. Three!  Four?", text.sentences) == ["One two", "Three", "Four?"]
    assert one(spark, "Don't  stop-now, 42!", text.tokens) == ["Don", "t", "stop", "now", "42"]
    assert one(spark, "", text.tokens) == []


def test_clean_tokens_keep_repeats_and_drop_stop_words(spark):
    assert one(spark, "The Moon, the moon! 42 m00n", text.clean_tokens) == ["moon", "moon", "mn"]
    assert one(spark, "the and of", text.clean_tokens) == []
    assert one(spark, "123 456", text.clean_tokens) == []
    assert one(spark, None, text.clean_tokens) is None


@pytest.mark.parametrize("body", [
    "Thé café, naïve 42 m00n ÀA a'b THE the_end 日本 x", "", "  ", "0 00 o0o", "\u0130t \u212a ſo \u0001z",
])
def test_clean_tokens_equal_their_single_steps(spark, body):
    steps = one(spark, body, lambda c: text.normalise(text.without(text.tokens(c))))
    assert one(spark, body, text.clean_tokens) == steps


def test_strip_markup(spark):
    assert one(spark, "a![img](emote|t5_2th52|4271)b", text.strip_markup) == "ab"


def test_unit_hash_is_uniform_and_stable(spark):
    df = spark.range(4000).select(hashing.unit_hash(F.col("id"), 3).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.02
    again = spark.range(4000).repartition(13).select(hashing.unit_hash(F.col("id"), 3).alias("u"))
    assert df.agg(F.sum(F.round("u", 6))).first()[0] == pytest.approx(
        again.agg(F.sum(F.round("u", 6))).first()[0])


def test_overlap_flag(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],), ([],)], "w array<string>")
    flags = df.select(keywords.overlaps_any(F.col("w"), ["b", "z"]).alias("f")).collect()
    assert [r.f for r in flags] == [True, False, False]
