"""Keyword, topic, length, term and sentiment reports over texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.keywords import TOPIC_WORDS, keyword_columns, topic_flag
from pulse.functions.text import STOP_WORDS, clean_tokens
from pulse.operators.activity import count_by, flag_rates, top_n_within
from pulse.operators.cleaning import computed_once
from pulse.operators.quantiles import approx_quantiles, exact_quantiles, quantile_report
from pulse.operators.sentiment import NEGATIVE, POSITIVE, sentiment_class
from pulse.operators.terms import corpus_terms, key_terms, top_terms


def topic_share(df: DataFrame, body: str, year: Column,
                words: Sequence[str] = TOPIC_WORDS) -> DataFrame:
    """Rows on and off a topic, per year."""
    flagged = df.select(year.alias("year"), topic_flag(F.col(body), words).alias("on_topic"))
    return count_by(flagged, ["year", "on_topic"])


def topic_hot_words(df: DataFrame, body: str, year: Column, words: Sequence[str], n: int,
                    stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The n most frequent words of topic texts per year, query words left out."""
    on_topic = df.filter(topic_flag(F.col(body), words)).select(year.alias("year"), body)
    terms = corpus_terms(on_topic, clean_tokens(F.col(body), stop), ["year"], words)
    return top_terms(terms, ["year"], n)


def keyword_rates(df: DataFrame, body: str, year: Column | None = None,
                  flags: Mapping[str, Column] | None = None,
                  totals: Sequence[str] = ()) -> DataFrame:
    """Share of texts with each keyword, per year or overall, in one pass."""
    flags = flags or keyword_columns(F.col(body))
    named = {name: F.col(name) for name in flags}
    columns = dict(flags) if year is None else {**flags, "year": year}
    by = [] if year is None else ["year"]
    return flag_rates(df.select(*[c.alias(n) for n, c in columns.items()]), named, by, totals)


def score_band(df: DataFrame, score: str, low: float, high: float,
               approx: bool = False) -> DataFrame:
    """Rows whose score lies between two quantiles, both ends included.

    The bounds are computed and stay inside the plan as one scalar subquery.
    """
    quantiles = approx_quantiles if approx else exact_quantiles
    bounds = quantiles(df, score, {"lo": low, "hi": high}).select(F.struct("lo", "hi")).scalar()
    return df.filter((F.col(score) >= bounds["lo"]) & (F.col(score) <= bounds["hi"]))


def feature_report(df: DataFrame, measures: Sequence[str], rates: Sequence[str],
                   by: str = "year", approx: bool = False) -> DataFrame:
    """Quantile rows for each measure and share rows for each 0/1 column, per period."""
    shares = df.groupBy(by).agg(*[F.avg(r).alias(r) for r in rates]).unpivot(
        by, list(rates), "feature_name", "percentage"
    )
    return quantile_report(df, measures, by, approx).unionByName(shares, allowMissingColumns=True)


def top_words(df: DataFrame, body: str, year: Column, n: int = 300,
              stop: Sequence[str] = STOP_WORDS, lemmas: Mapping[str, str] | None = None) -> DataFrame:
    """The n most frequent clean words of each year."""
    rows = df.select(year.alias("year"), body)
    return top_terms(corpus_terms(rows, clean_tokens(F.col(body), stop, lemmas), ["year"]), ["year"], n)


def key_words(df: DataFrame, doc: str, body: str, period: Column, n: int | None = None,
              stop: Sequence[str] = STOP_WORDS, min_docs: int = 1,
              lemmas: Mapping[str, str] | None = None) -> DataFrame:
    """Words most often the highest-TF-IDF word of a text, per period.

    Each period has its own document frequencies, as if fitted alone.
    """
    rows = df.select(doc, period.alias("period"), body)
    counts = key_terms(rows, doc, clean_tokens(F.col(body), stop, lemmas), ["period"], min_docs)
    return counts if n is None else top_n_within(counts, ["period"], "term", n, "n_docs")


def with_sentiment(df: DataFrame, body: str, positive: Sequence[str] = POSITIVE,
                   negative: Sequence[str] = NEGATIVE, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Clean tokens, their number and the sentiment class of each text."""
    return computed_once(df, "tokens", clean_tokens(F.col(body), stop)).withColumns({
        "length_of_body": F.size("tokens"),
        "sentiment_class": sentiment_class(F.col("tokens"), positive, negative),
    })


def sentiment_summary(classified: DataFrame, year: Column, measures: Mapping[str, Column],
                      flags: Mapping[str, Column]) -> DataFrame:
    """Average measures and flag shares per (year, class)."""
    averages = {**measures, **{name: flag.cast("int") for name, flag in flags.items()}}
    return classified.groupBy(year.alias("year"), "sentiment_class").agg(
        *[F.avg(c).alias(name) for name, c in averages.items()]
    )
