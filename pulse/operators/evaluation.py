"""Model quality and explanation, from one pass over the predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.activity import count_by
from pulse.operators.ranking import summed_before
from pulse.operators.sampling import stack_tagged
from pulse.operators.scaling import minmax_scale


def confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction)."""
    return count_by(predictions, [label, prediction])


def class_accuracy(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Share of correct predictions within each class, keyed by the label itself."""
    return predictions.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("class_accuracy"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def binary_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, test error, weighted F1 and balanced accuracy of 0/1 predictions.

    Balanced accuracy, the mean accuracy of both classes, is what an "AUC" of
    hard predictions amounts to; see :func:`area_under_roc` for the real one.
    """
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    cells = predictions.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    f1_yes, f1_no = _share(2 * tp, 2 * tp + fp + fn), _share(2 * tn, 2 * tn + fn + fp)
    accuracy = _share(tp + tn, total)
    return cells.select(
        total.alias("n"), accuracy.alias("accuracy"), (1 - accuracy).alias("test_error"),
        _share((tp + fn) * f1_yes + (tn + fp) * f1_no, total).alias("f1"),
        ((_share(tp, tp + fn) + _share(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def area_under_roc(predictions: DataFrame, label: str, score: Column) -> DataFrame:
    """Area under the ROC curve of a score (column ``auc``), exact, with ties counted half; NULL with one class only.

    It is the share of pairs of a positive and a negative row in which the positive one
    scores higher: of each score, all negatives below it and half of those beside it.
    Scores are counted first and ordered in ranges, so no task sees all of them. Rows
    without a score are left out; NaN is the highest score.
    """
    y = F.col(label).cast("int")
    scores = predictions.select(score.alias("score"), y.alias("y")).where(
        F.col("score").isNotNull() & F.col("y").isin(0, 1)).groupBy("score").agg(
        F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    below = summed_before(scores, [F.asc("score")], "no", "below")
    pairs = F.sum(F.col("yes") * (F.col("below") + F.col("no") / 2))
    return below.agg(F.try_divide(pairs, F.sum("yes").cast("double") * F.sum("no")).alias("auc"))


def positive_score(raw: str = "rawPrediction") -> Column:
    """A model's score for the positive class."""
    return vector_to_array(raw)[1]


def model_report(predictions: DataFrame, label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """:func:`binary_report` with the area under the ROC curve of the raw scores."""
    auc = area_under_roc(predictions, label, positive_score())
    return binary_report(predictions, label, prediction).withColumn("auc", auc.scalar())


def compare_models(reports: Mapping[str, DataFrame]) -> DataFrame:
    return stack_tagged(reports, "model")


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the assembled features, in vector order, from column metadata."""
    attributes = df.schema[features].metadata["ml_attr"]["attrs"]
    flat = [a for kind in attributes.values() for a in kind]
    return [a["name"] for a in sorted(flat, key=lambda a: a["idx"])]


def importances(df: DataFrame, model: Model, features: str = "features") -> DataFrame:
    """Importance of each named feature: tree importances, or absolute coefficients.

    As many rows as the model has features; nothing else passes the driver.
    """
    values = (
        model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    ).toArray()
    rows = [
        (name, abs(float(v))) for name, v in zip(feature_names(df, features), values, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def scaled_importances(by_model: Mapping[str, DataFrame]) -> DataFrame:
    """Importances of several models side by side, each mapped to [0, 1]."""
    joined: DataFrame | None = None
    for name, df in by_model.items():
        one = df.withColumnRenamed("importance", name)
        joined = one if joined is None else joined.join(one, ["feature"], "full_outer")
    return minmax_scale(joined, list(by_model))


def ranked_importances(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("importance"), F.asc("feature"))
