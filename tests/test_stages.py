"""Stages that spare work: dealt by key, and read once."""

import pytest
from pyspark.sql import functions as F

from pulse.catalog import REGISTRY, Tables
from pulse.operators import sentiment, terms

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bucketed_large_groups", "bucketed_daily"])
def test_bucketed_stages_join_without_a_shuffle(spark, no_broadcast, name):
    plan = plan_of(REGISTRY[name].build(Tables(spark, FOLDER)))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["lemmatised_text", "sentiment_by_table"])
def test_texts_are_read_once(spark, name):
    assert "documents.parquet" not in plan_of(REGISTRY[name].build(Tables(spark, FOLDER)))


def test_dictionary_tables_of_any_size(spark, rows):
    df = spark.createDataFrame(
        [(1, ["b", "a", "b"]), (2, []), (None, ["a", "z"]), (3, ["q"]), (1, ["c"])], "id int, w array<string>")
    lemmas = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("token"), F.lit("y").alias("lemma")).union(
        spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "token string, lemma string"))
    assert rows(terms.lemmatise(df, "id", "w", lemmas)) == sorted(
        [(1, ["B", "A", "B"]), (2, []), (None, ["A", "z"]), (3, ["q"]), (1, ["C"])], key=str)
    lexicon = lemmas.select(F.col("token").alias("term"), F.when(F.col("lemma") == "A", -3).otherwise(1).alias("weight"))
    assert rows(sentiment.sentiment_from_table(df, "id", "w", lexicon).select("id", "sentiment_class")) == sorted(
        [(1, "negative"), (2, ""), (None, "negative"), (3, "neutral"), (1, "positive")], key=str)
