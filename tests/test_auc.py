"""The area under the curve against pairs of rows and against MLlib."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pulse.operators import evaluation


@pytest.mark.parametrize("values", [2, 9, 10_000])
def test_share_of_ordered_pairs(spark, values):
    rng = random.Random(values)
    rows = [(rng.randrange(2), float(rng.randrange(values))) for _ in range(300)]
    wins = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    df = spark.createDataFrame([*rows, (1, None), (None, 1.0)], "label int, s double")
    got = evaluation.area_under_roc(df, "label", F.col("s")).first().auc
    assert got == pytest.approx(sum(wins) / len(wins))
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="s")
    assert got == pytest.approx(judge.evaluate(df.dropna().withColumn("label", F.col("label").cast("double"))))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, s double")
    assert evaluation.area_under_roc(df, "label", F.col("s")).first().auc is None
    assert evaluation.area_under_roc(df.limit(0), "label", F.col("s")).first().auc is None
