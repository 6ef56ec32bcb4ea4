"""Lexicon sentiment: positive, negative, neutral, or '' for texts without words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.terms import looked_up

# A small general lexicon; pass your own for real work.
POSITIVE = (
    "amazing", "awesome", "best", "excellent", "fantastic", "fun", "gain", "glad", "good",
    "great", "happy", "hope", "like", "love", "lucky", "nice", "perfect", "profit", "thanks",
    "win",
)
NEGATIVE = (
    "angry", "awful", "bad", "clown", "crash", "fail", "garbage", "hate", "horrible", "idiot",
    "lose", "loss", "moron", "pathetic", "sad", "stupid", "terrible", "trash", "worst",
    "worthless",
)


def _class(n_tokens: Column, score: Column) -> Column:
    # picked by sign, so that the score is evaluated once
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    return F.when(n_tokens == 0, "").otherwise(
        F.element_at(names, (F.signum(score) + 2).cast("int"))
    )


def sentiment_class(tokens: Column, positive: Sequence[str] = POSITIVE,
                    negative: Sequence[str] = NEGATIVE) -> Column:
    """Class from a word list, evaluated inside the row: no join and no shuffle."""
    score = F.size(F.filter(tokens, lambda t: t.isin(*positive))) - F.size(
        F.filter(tokens, lambda t: t.isin(*negative))
    )
    return _class(F.size(tokens), score)


def sentiment_from_table(df: DataFrame, doc: str, tokens: str, lexicon: DataFrame) -> DataFrame:
    """Class from a lexicon table (term, weight), for lexicons too large for a list."""
    table = lexicon.groupBy("term").agg(F.sum("weight").alias("value"))
    found = looked_up(df, doc, tokens, table, "weight_of")
    score = F.aggregate(tokens, F.lit(0).cast("double"), lambda total, t: total + F.coalesce(
        F.try_element_at("weight_of", t).cast("double"), F.lit(0.0)))
    return found.withColumn("sentiment_class", _class(F.size(tokens), score)).drop("weight_of")
