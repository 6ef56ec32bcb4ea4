"""Whole grids, with work shared between settings."""

import pytest
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulse.operators import forests, learning, tuning


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return df.withColumn("outcome", F.when(
        (F.col("x") > 3) & (F.col("z") > 2) | (F.col("kind") == "even"), "yes").otherwise("no")).cache()


def searched(planted, kind, grid, **options):
    return tuning.search(planted, learning.feature_stages(["kind"], ["kind"], ["x", "z"]), kind, grid,
                         learning.label_indexer(planted, "outcome"), "id", folds=2, **options)


def test_first_trees_are_a_forest_of_their_own(planted):
    stages = [learning.label_indexer(planted, "outcome"), *learning.feature_stages(["kind"], ["kind"], ["x", "z"])]
    rows = Pipeline(stages=stages).fit(planted).transform(planted)
    forest = learning.classifier("forest", numTrees=5, maxDepth=3).fit(rows)
    got = tuning.with_first_trees(rows, forest._java_obj, [5, 2]).orderBy("id").collect()
    whole = forest.transform(rows).orderBy("id").collect()
    assert [r.p0 for r in got] == [r.prediction for r in whole]
    votes = [[r.v for r in t.transform(rows).orderBy("id").select(vector_to_array("probability").alias("v")).collect()]
             for t in forest.trees[:2]]
    assert [r.p1 for r in got] == [float(a[1] + b[1] > a[0] + b[0]) for a, b in zip(*votes, strict=True)]


@pytest.mark.parametrize("leak_free", [True, False])
def test_every_setting_of_a_forest_grid_is_judged(planted, leak_free):
    grid = {"numTrees": [1, 3, 9], "maxDepth": [0, 4], "maxBins": [8, 16]}
    found = searched(planted, "forest", grid, leak_free=leak_free)
    assert len(found.settings) == len(found.accuracies) == 12
    assert found.best["maxDepth"] == 4 and found.accuracies[found.settings.index(found.best)] > 0.9
    best = learning.classifier_of(found.model)
    assert {k: best.getOrDefault(k) for k in grid} == found.best
    assert found.table(planted).count() == 12


def test_thresholds_of_one_fit_equal_fits_of_their_own(planted):
    grid = {"regParam": [0.01, 0.3], "threshold": [0.2, 0.5, 0.9], "elasticNetParam": [0.0, 0.5]}
    found = searched(planted, "logistic", grid)
    assert len(found.settings) == 12
    for setting in (found.settings[1], found.settings[-1]):
        alone = searched(planted, "logistic", {k: [v] for k, v in setting.items()})
        assert alone.accuracies == pytest.approx([found.accuracies[found.settings.index(setting)]])
    assert learning.classifier_of(found.model).getThreshold() == found.best["threshold"]


def test_settings_without_a_shared_part(planted):
    found = searched(planted, "svm", {"regParam": [0.01, 100.0]})
    assert found.best == {"regParam": 0.01} and len(found.settings) == 2


def test_forests_of_lesser_depth_are_cut_from_the_deepest(spark):
    rows = spark.range(400).select(
        "id", *[((F.col("id") * k) % 23 + F.col("id") % 3).cast("double").alias(f"x{k}") for k in (3, 5, 7)],
        (F.xxhash64("id") % 5).cast("string").alias("outcome"))
    stages = [learning.label_indexer(rows, "outcome"), *learning.feature_stages(["outcome"], [], ["x3", "x5", "x7"])[1:]]
    stages[-1].setInputCols(["x3", "x5", "x7"])
    rows = Pipeline(stages=stages).fit(rows).transform(rows).cache()
    # one tree on all features has no choice of columns left, so each depth can be grown alone as well
    deep = learning.classifier("forest", numTrees=1, maxDepth=6).setFeatureSubsetStrategy("all").fit(rows)
    got = [r.predictions for r in forests.with_smaller_forests(
        rows, deep._java_obj, [(1, d) for d in (0, 1, 3, 6)]).orderBy("id").collect()]
    for i, depth in enumerate((0, 1, 3, 6)):
        alone = learning.classifier("forest", numTrees=1, maxDepth=depth).setFeatureSubsetStrategy("all").fit(rows)
        assert [p[i] for p in got] == [r.prediction for r in alone.transform(rows).orderBy("id").collect()]
    many = learning.classifier("forest", numTrees=7, maxDepth=5).fit(rows)
    first = tuning.with_first_trees(rows, many._java_obj, [7, 3]).orderBy("id").collect()
    both = forests.with_smaller_forests(rows, many._java_obj, [(7, 5), (2, 2), (3, 5)]).orderBy("id").collect()
    assert [(r.p0, r.p1) for r in first] == [(r.predictions[0], r.predictions[2]) for r in both]


def test_a_grid_of_forests_is_grown_once_for_each_number_of_bins():
    groups = {k: len(tuning._groups(k, grid)) for k, grid in learning.GRIDS.items()}
    assert groups == {"forest": 5, "logistic": 12, "svm": 3, "text_forest": 3}


class Counted(Transformer):
    """A text as ``clean_text``, which learns nothing and counts the rows that it makes."""

    def __init__(self, rows):
        super().__init__()
        self.rows = rows

    def _transform(self, df):
        rows = self.rows

        @F.udf("string")
        def counted(text):
            rows.add(1)
            return text

        return df.withColumn("clean_text", counted("text"))


@pytest.mark.parametrize("kind, grid", [
    ("logistic", {"regParam": [0.1, 0.4], "threshold": [0.5]}), ("text_forest", {"numTrees": [2, 3], "maxDepth": [1, 2], "maxBins": [8, 16]})])
def test_stages_that_learn_nothing_run_once_for_all_folds(spark, kind, grid):
    rows = spark.range(200).select(
        "id", F.concat_ws(" ", (F.col("id") % 2).cast("string"), F.lit("word"), (F.col("id") % 9).cast("string")).alias("text"),
        F.when((F.xxhash64("id") % 5 == 0) | (F.col("id") % 2 == 0), "yes").otherwise("no").alias("outcome"))
    made = spark.sparkContext.accumulator(0)
    stages = [Counted(made), *learning.text_stages("clean_text", 50, 1)]
    indexer = learning.label_indexer(rows, "outcome")
    found = tuning.search(rows, stages, kind, grid, indexer, "id", folds=3)
    assert made.value == 200
    # the refitted model is the one that a pipeline of all stages gives
    alone = learning.fit(rows, stages, learning.classifier(kind, **found.best), indexer)
    got, wanted = ([r.prediction for r in m.transform(rows).orderBy("id").collect()] for m in (found.model, alone))
    assert got == wanted and len(found.model.stages) == len(alone.stages)


def test_forests_keep_the_nodes_of_rows_and_grow_the_same_trees(planted):
    found = searched(planted, "forest", {"numTrees": [3], "maxDepth": [0, 4], "maxBins": [8]})
    model = learning.classifier_of(found.model)
    assert model.getCacheNodeIds()
    alone = learning.fit(planted, learning.feature_stages(["kind"], ["kind"], ["x", "z"]),
                         learning.classifier("forest", **found.best), learning.label_indexer(planted, "outcome"))
    trees = [[t.toDebugString.split("\n", 1)[1] for t in m.trees] for m in (model, learning.classifier_of(alone))]
    assert trees[0] == trees[1]
