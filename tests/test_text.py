import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulse.functions.text import clean_tokens, tokens
from pulse.operators import sentiment, terms
from pulse.plans import text


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, 2021, "apple apple banana"), (2, 2021, "apple cherry"), (3, 2021, "apple"),
        (4, 2022, "banana banana cherry"), (5, 2022, "42"), (6, 2022, "banana date"),
    ], "id int, year int, body string")


def brute_key_terms(rows):
    """Key word of each document by the stated rule, one period at a time."""
    result = Counter()
    for year in {r.year for r in rows}:
        period = [r for r in rows if r.year == year]
        words = {r.id: Counter(w for w in r.body.split() if w.isalpha()) for r in period}
        df = Counter(w for c in words.values() for w in c)
        for counts in words.values():
            ranked = sorted(
                (-tf * math.log((len(period) + 1) / (df[w] + 1)), -df[w], w) for w, tf in counts.items())
            if ranked and ranked[0][0] < 0:
                result[year, ranked[0][2]] += 1
    return result


@pytest.mark.parametrize("hot_terms", [0, 2, 5, 100_000])
def test_key_terms_match_brute_force_wherever_hot_begins(spark, docs, monkeypatch, hot_terms):
    monkeypatch.setattr(terms, "HOT_TERMS", hot_terms)
    got = {(r.period, r.term): r.n_docs
           for r in text.key_words(docs, "id", "body", F.col("year"), stop=()).collect()}
    assert got == dict(brute_key_terms(docs.collect()))


def test_weights_read_staged_counts_and_no_texts(spark, docs, tmp_path):
    folder = str(tmp_path / "texts")
    docs.write.parquet(folder)
    weights = terms.tf_idf(spark.read.parquet(folder), "id", clean_tokens(F.col("body"), ()), ["year"])
    assert weights.inputFiles() and not any(folder in f for f in weights.inputFiles())


def test_vectorised_terms_read_staged_counts_and_no_texts(spark):
    from pulse.catalog import REGISTRY, Tables
    cells = REGISTRY["vectorised_terms"].build(Tables(spark, "/root/testdata/sf0.001"))
    assert cells.inputFiles() and not any("documents.parquet" in f for f in cells.inputFiles())


def test_texts_without_terms_have_no_key_word(docs):
    weights = terms.tf_idf(docs, "id", clean_tokens(F.col("body"), ()), ["year"])
    keyed = {r.id: r.term for r in terms.best_terms(weights, "id", ["year"]).collect()}
    assert 5 not in keyed      # no letters
    assert 3 not in keyed      # its only term is in every text of the year: weight 0
    assert keyed[1] == "banana" and keyed[2] == "cherry"


def test_null_period_keeps_its_key_words(spark):
    df = spark.createDataFrame([(1, None, "x y"), (2, None, "y"), (3, 2021, "z"), (4, 2021, "q")],
                               "id int, year int, body string")
    got = {(r.period, r.term) for r in text.key_words(df, "id", "body", F.col("year"), stop=()).collect()}
    assert got == {(None, "x"), (2021, "z"), (2021, "q")}


def test_vector_form_agrees_with_long_form(spark, docs):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from pulse.operators import learning
    rows = docs.withColumn("w", clean_tokens(F.col("body"), ()))
    model = Pipeline(stages=learning.count_stages("w")).fit(rows)
    cells = model.transform(rows).select(
        "id", F.posexplode(vector_to_array("weights")).alias("index", "weight")).filter("weight > 0")
    table = spark.createDataFrame(list(enumerate(model.stages[0].vocabulary)), "index int, word string")
    decoded = {(r.id, r.word): r.weight for r in terms.decode_index(cells, "index", table).collect()}
    long = terms.tf_idf(rows, "id", F.col("w")).filter("tf_idf > 0")
    assert decoded == pytest.approx({(r.id, r.term): r.tf_idf for r in long.collect()})


def test_top_words_of_each_year(docs):
    got = {(r.year, r.term, r.n) for r in text.top_words(docs, "body", F.col("year"), 1, ()).collect()}
    assert got == {(2021, "apple", 4), (2022, "banana", 3)}


def test_hot_words_leave_out_query_words(docs):
    got = text.topic_hot_words(docs, "body", F.col("year"), ["apple"], 5, ())
    assert {(r.year, r.term) for r in got.collect()} == {(2021, "banana"), (2021, "cherry")}


def test_lemmas_keep_order_and_empty_texts(spark):
    lemmas = spark.createDataFrame([("ran", "run"), ("cats", "cat")], "token string, lemma string")
    df = spark.createDataFrame([(1, ["cats", "ran", "home", "cats"]), (2, [])], "id int, w array<string>")
    got = {r.id: r.w for r in terms.lemmatise(df, "id", "w", lemmas).collect()}
    assert got == {1: ["cat", "run", "home", "cat"], 2: []}


@pytest.mark.parametrize("body, expected", [
    ("good good bad", "positive"), ("bad", "negative"), ("good bad", "neutral"), ("house", "neutral"),
    ("", ""), ("12", ""),
])
def test_sentiment_list_and_table_agree(spark, body, expected):
    df = spark.createDataFrame([(1, body)], "id int, body string").withColumn(
        "w", clean_tokens(F.col("body")))
    by_list = df.select(sentiment.sentiment_class(F.col("w"), ["good"], ["bad"])).first()[0]
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "term string, weight int")
    by_table = sentiment.sentiment_from_table(df, "id", "w", lexicon).first().sentiment_class
    assert by_list == by_table == expected


def test_score_band_keeps_both_ends(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "s int")
    assert sorted(r.s for r in text.score_band(df, "s", 0.95, 0.99).collect()) == [95, 96, 97, 98, 99]


def test_keyword_rates_per_year_and_overall(spark):
    df = spark.createDataFrame([(2021, "job $1"), (2021, "none"), (2022, "jobs...")], "y int, b string")
    years = {r.year: (r.dollar, r.ellipsis, r.labor) for r in
             text.keyword_rates(df, "b", F.col("y")).collect()}
    assert years == {2021: (0.5, 0.0, 0.5), 2022: (0.0, 1.0, 1.0)}
    row = text.keyword_rates(df, "b", totals=["labor"]).first()
    assert row.labor_sum == 2


def test_each_year_uses_its_own_texts(spark):
    df = spark.createDataFrame([(2021, "mask one"), (2022, "mask two")], "y int, b string")
    got = {(r.year, r.term) for r in text.topic_hot_words(df, "b", F.col("y"), ["mask"], 9, ()).collect()}
    assert got == {(2021, "one"), (2022, "two")}


def test_repeated_tokens_stay(spark):
    df = spark.createDataFrame([(1, "a a b")], "id int, body string")
    got = {r.term: r.tf for r in terms.term_counts(df, "id", tokens(F.col("body"))).collect()}
    assert got == {"a": 2, "b": 1}
