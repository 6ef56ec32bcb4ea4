import pytest
from pyspark.sql import functions as F

from pulse.functions.timefx import in_year
from pulse.operators import evaluation, learning, sampling
from pulse.plans import training


@pytest.fixture(scope="module")
def planted(spark):
    """Rows whose label follows a number and a category."""
    df = spark.range(400).select(
        "id", (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"),
    )
    return df.withColumn(
        "outcome", F.when((F.col("x") > 3) | (F.col("kind") == "even"), "yes").otherwise("no")
    ).cache()


def report_of(model, df):
    return evaluation.model_report(model.transform(df)).first()


@pytest.mark.parametrize("kind", ["forest", "logistic", "svm", "boosted"])
def test_models_beat_the_majority_class(planted, kind):
    train, test = sampling.hash_split(planted, [0.8, 0.2], "id")
    indexer = learning.label_indexer(planted, "outcome")
    params = {"svm": {"maxIter": 10}, "boosted": {"maxIter": 3}}.get(kind, {})
    model = learning.fit(train, learning.feature_stages(["kind"], ["kind"], ["x"]),
                         learning.classifier(kind, **params), indexer)
    majority = test.filter("outcome = 'yes'").count() / test.count()
    row = report_of(model, test)
    assert row.accuracy > majority and row.accuracy + row.test_error == pytest.approx(1)
    names = model.transform(test).select("predicted").distinct().collect()
    assert {r.predicted for r in names} <= {"yes", "no"}


@pytest.mark.parametrize("leak_free", [True, False])
def test_cross_validation_picks_the_better_setting(planted, leak_free):
    model = learning.cross_validate(
        planted, learning.feature_stages(["kind"], ["kind"], ["x"]), learning.classifier("forest"),
        {"maxDepth": [0, 4], "numTrees": [5]}, learning.label_indexer(planted, "outcome"), folds=2,
        leak_free=leak_free)
    assert learning.classifier_of(model).getOrDefault("maxDepth") == 4
    assert report_of(model, planted).accuracy > 0.95


def test_saved_model_predicts_the_same(planted, tmp_path):
    model = learning.fit(planted, learning.feature_stages(["kind"], [], ["x"]),
                         learning.classifier("forest", numTrees=3), learning.label_indexer(planted, "outcome"))
    again = learning.load_model(learning.save(model, str(tmp_path / "m")))
    a, b = (m.transform(planted).orderBy("id").select("id", "predicted").collect() for m in (model, again))
    assert a == b


def test_published_grids_have_their_published_sizes():
    sizes = {name: len(learning.grid_of(learning.classifier(name), grid))
             for name, grid in learning.GRIDS.items()}
    assert sizes == {"forest": 120, "logistic": 36, "svm": 3, "text_forest": 27}


def test_report_reproduces_a_published_confusion_matrix(spark):
    cells = [(0, 0, 6589), (0, 1, 1190), (1, 0, 481), (1, 1, 7339)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    row = evaluation.binary_report(df, "label", "prediction").first()
    assert row.n == 15599
    assert row.accuracy == pytest.approx(0.892878, abs=1e-6)
    assert row.balanced_accuracy == pytest.approx(0.892758, abs=1e-6)
    within = {r.label: r.class_accuracy for r in
              evaluation.class_accuracy(df, "label", "prediction").collect()}
    assert within == pytest.approx({0: 0.847024, 1: 0.938491}, abs=1e-6)
    matrix = evaluation.confusion(df, "label", "prediction").collect()
    assert sorted((r.label, r.prediction, r.n) for r in matrix) == cells


def test_report_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    df = spark.range(200).select((F.col("id") % 3 == 0).cast("double").alias("label"),
                                 (F.col("id") % 5 < 2).cast("double").alias("prediction"))
    row = evaluation.binary_report(df, "label", "prediction").first()
    for metric, value in (("accuracy", row.accuracy), ("f1", row.f1)):
        judge = MulticlassClassificationEvaluator(labelCol="label", metricName=metric)
        assert judge.evaluate(df) == pytest.approx(value)


def test_importances_carry_feature_names_and_scale(planted):
    indexer = learning.label_indexer(planted, "outcome")
    stages = learning.feature_stages(["kind"], ["kind"], ["x"])
    models = {k: learning.fit(planted, stages, learning.classifier(k), indexer) for k in ("forest", "logistic")}
    names = evaluation.feature_names(models["forest"].transform(planted))
    table = training.importance_comparison(models, planted).collect()
    assert {r.feature for r in table} == set(names)
    for kind in models:
        values = [r[kind] for r in table]
        assert min(values) == 0.0 and max(values) == 1.0


def test_index_ranks_agree_with_the_indexer(planted):
    ranks = learning.index_ranks(planted, "kind").orderBy("index").collect()
    from pyspark.ml.feature import StringIndexer
    labels = StringIndexer(inputCol="kind", outputCol="k").fit(planted).labels
    assert [r.value for r in ranks] == list(labels)


def comments(spark):
    rows = []
    for i in range(40):
        author = "[deleted]" if i % 4 == 0 else f"user{i}"
        body = ["[deleted]", "[removed]", "a good day", "worst idea ever", "plain words"][i % 5]
        rows.append((str(i), author, body, 1612137600, i, 0, 1 if i % 4 == 0 else 0,
                     "false" if i % 2 else "1612137601", True, False))
    return spark.createDataFrame(
        rows, "id string, author string, body string, created_utc long, score int, "
              "controversiality int, gilded int, edited string, is_submitter boolean, stickied boolean")


def test_deleted_set_marks_removed_texts_unknown(spark):
    df = training.deleted_set(comments(spark), in_year(F.col("created_utc"), 2021, True), ["idea"], ["good"], ["worst"])
    got = df.collect()
    assert got and len({r.id for r in got}) == len(got)   # no row is drawn twice
    assert sum(r.deleted for r in got) == 8               # the smaller class is whole
    for r in got:
        unknown = (r.contain_often_deleted_words, r.sentiment_class) == ("unknown", "unknown")
        assert unknown is r.removed_by_mod
        if not r.removed_by_mod:
            assert r.contain_often_deleted_words == ("true" if int(r.id) % 5 == 3 else "false")


def test_award_set_is_complete_and_real(spark):
    df = training.award_set(comments(spark))
    got = df.collect()
    assert "gilded" not in df.columns and got
    assert not {r.body for r in got} & {"[deleted]", "[removed]", ""}
    assert sum(r.gilded_or_not for r in got) == 6
