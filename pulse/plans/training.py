"""Training sets, models and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.keywords import overlaps_any
from pulse.functions.text import NOTICE_PATTERNS, clean_tokens, joined, tokens
from pulse.functions.timefx import calendar_parts
from pulse.functions.values import (
    DELETED,
    REMOVED,
    UNKNOWN,
    blank_to_unknown,
    flag_int,
    has_award,
    is_edited,
)
from pulse.operators import evaluation, learning, tuning
from pulse.operators.cleaning import computed_once, drop_incomplete, drop_matching, drop_tombstones
from pulse.operators.sampling import balance, hash_split
from pulse.operators.sentiment import sentiment_class
from pulse.sources.sinks import cached

# The columns and model settings of the published training sets.
AWARD_COLUMNS = (
    "id", "body", "controversiality", "created_utc", "edited", "gilded", "is_submitter", "score",
    "stickied",
)
AWARD_CATEGORIES = ("controversiality", "hour", "day_of_week", "sentiment_class")
AWARD_ENCODED = ("hour", "day_of_week", "sentiment_class")
AWARD_NUMBERS = (
    "edited", "is_submitter", "score", "stickied", "length_of_clean_body", "length_of_raw_body",
)
DELETED_CATEGORIES = ("contain_often_deleted_words", "sentiment_class")
DELETED_NUMBERS = (
    "controversiality", "edited", "gilded", "is_submitter", "score", "stickied", "removed_by_mod",
)


def award_set(comments: DataFrame, seed: int = 0) -> DataFrame:
    """Balanced rows for "will a comment be gilded": complete, real texts only."""
    complete = drop_incomplete(comments.select(*AWARD_COLUMNS))
    real = drop_matching(drop_tombstones(complete, "body"), "body", NOTICE_PATTERNS)
    labelled = real.withColumn("gilded_or_not", has_award(F.col("gilded")))
    return balance(labelled, "gilded_or_not", "id", seed).drop("gilded")


def award_features(balanced: DataFrame, time: Column, positive: Sequence[str],
                   negative: Sequence[str]) -> DataFrame:
    """Time, length and sentiment features, and the clean text, in one projection."""
    parts = calendar_parts(time)
    return computed_once(balanced, "clean", clean_tokens(F.col("body"))).withColumns({
        "hour": parts["hour"],
        "day_of_week": parts["day_of_week"],
        "edited": is_edited(F.col("edited")),
        "length_of_clean_body": F.size("clean"),
        "length_of_raw_body": F.size(tokens(F.col("body"))),
        "sentiment_class": blank_to_unknown(sentiment_class(F.col("clean"), positive, negative)),
        "clean_text": joined(F.col("clean")),
        "gilded_or_not": flag_int(F.col("gilded_or_not")),
    }).drop("clean", "body", "created_utc")


def deleted_set(comments: DataFrame, in_period: Column, frequent_words: Sequence[str],
                positive: Sequence[str], negative: Sequence[str], seed: int = 0) -> DataFrame:
    """Balanced rows for "was the account deleted".

    Texts removed by moderators cannot be read, so their text features are
    'unknown'. Deleted and other accounts are told apart before sampling, so no
    row can be drawn twice.
    """
    complete = drop_incomplete(comments.select("author", *AWARD_COLUMNS))
    known = drop_tombstones(complete, "body", (DELETED,)).withColumn(
        "deleted", F.col("author") == DELETED
    )
    rows = balance(known, "deleted", "id", seed).filter(in_period)
    removed = F.col("body") == REMOVED
    marked = computed_once(rows, "words", clean_tokens(F.col("body")))
    return marked.withColumn("removed_by_mod", removed).select(
        "id", "controversiality", is_edited(F.col("edited")).alias("edited"), "gilded",
        "is_submitter", "score", "stickied", "removed_by_mod",
        F.when(F.col("removed_by_mod"), UNKNOWN).otherwise(
            overlaps_any(F.col("words"), frequent_words).cast("string")
        ).alias("contain_often_deleted_words"),
        F.when(F.col("removed_by_mod"), UNKNOWN).otherwise(
            sentiment_class(F.col("words"), positive, negative)
        ).alias("sentiment_class"),
        "deleted",
    )


def _settings(kind: str) -> dict:
    """Settings each published model keeps."""
    return {"forest_deleted": {"numTrees": 50}}.get(kind, {})


def award_search(train: DataFrame, kind: str, grid: Mapping[str, Sequence] | None = None,
                 folds: int = learning.FOLDS, parallelism: int = 8, leak_free: bool = True) -> tuning.Search:
    """All settings of a grid tried for "gilded", from row features or from text; the published grid by default."""
    from_text = kind in ("svm", "text_forest")
    stages = (
        learning.text_stages("clean_text") if from_text
        else learning.feature_stages(AWARD_CATEGORIES, AWARD_ENCODED, AWARD_NUMBERS)
    )
    return tuning.search(
        train, stages, kind, grid or learning.GRIDS[kind], learning.label_indexer(train, "gilded_or_not"),
        "id", folds, parallelism, leak_free=leak_free)


def tuned_award_model(train: DataFrame, kind: str, grid: Mapping[str, Sequence] | None = None,
                      folds: int = learning.FOLDS, parallelism: int = 8,
                      leak_free: bool = True) -> PipelineModel:
    """The refitted best model of :func:`award_search`."""
    return award_search(train, kind, grid, folds, parallelism, leak_free).model


def deleted_models(train: DataFrame, kinds: Sequence[str] = ("forest", "svm", "boosted")
                   ) -> dict[str, PipelineModel]:
    """One fitted model per kind for "was the account deleted"."""
    stages = learning.feature_stages(DELETED_CATEGORIES, DELETED_CATEGORIES, DELETED_NUMBERS)
    indexer = learning.label_indexer(train, "deleted")
    with cached(train):
        return {
            kind: learning.fit(
                train, stages,
                learning.classifier(kind, **(_settings("forest_deleted") if kind == "forest" else {})),
                indexer,
            )
            for kind in kinds
        }


def deleted_splits(rows: DataFrame, seed: int = 0) -> list[DataFrame]:
    """Training, test and held-out parts: 80, 18 and 2 percent."""
    usable = rows.filter(F.col("sentiment_class") != "").withColumn(
        "deleted", F.col("deleted").cast("string")
    )
    return hash_split(usable, [0.8, 0.18, 0.02], "id", seed)


def model_comparison(models: Mapping[str, PipelineModel], test: DataFrame) -> DataFrame:
    """Quality of several models on one test set, one row each."""
    with cached(test):
        return evaluation.compare_models({
            name: evaluation.model_report(model.transform(test)) for name, model in models.items()
        })


def importance_comparison(models: Mapping[str, PipelineModel], sample: DataFrame) -> DataFrame:
    """Feature importance of several models, each mapped to [0, 1]."""
    return evaluation.scaled_importances({
        name: evaluation.importances(model.transform(sample), learning.classifier_of(model))
        for name, model in models.items()
    })
