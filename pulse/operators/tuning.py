"""Grid search over whole grids, sharing what settings have in common.

Trying every setting by itself fits the feature stages, and grows every tree, once for
each setting and fold. Here

* the leading feature stages that learn nothing (tokens, hashed counts) run once, on all rows;
* other feature stages are fitted once a fold and their vectors kept while it is searched;
* a forest is the sum of its trees' votes, so the forests of 25, 50, ... 150 trees of one
  number of bins are the first trees of the same 150, and those of lesser depth are these
  trees cut at that depth (:mod:`pulse.operators.forests`);
* thresholds are applied to the scores of one fitted model;
* all settings that share a fit are judged in one pass over the held-out rows.

So the published grid of 120 forests costs 5 forests of the largest size, and one of 36
regressions costs 12. Forests keep the node of every row and tree from level to level
(``cacheNodeIds``) and do not look it up from the root again; the trees are the same. Scores
are accuracies, averaged over folds; of equal settings the first in the grid wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product, takewhile
from multiprocessing.pool import ThreadPool

from py4j.java_gateway import JavaObject
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.hashing import unit_hash
from pulse.operators import learning
from pulse.operators.forests import with_smaller_forests
from pulse.operators.learning import FEATURES, FOLD, FOLDS, LABEL
from pulse.session import use_checkpoints
from pulse.sources.sinks import cached

#: The parameters of each kind of model that need no fit of their own.
SHARED = {"forest": ("numTrees", "maxDepth"), "text_forest": ("numTrees", "maxDepth"), "logistic": ("threshold",)}

#: How each kind of model is grown, whatever the setting; its predictions do not depend on it.
GROWN = {"forest": {"cacheNodeIds": True}, "text_forest": {"cacheNodeIds": True}}


@dataclass(frozen=True)
class Search:
    """The refitted best model, and every setting with its accuracy over all folds."""

    model: PipelineModel
    settings: list[dict]
    accuracies: list[float]

    @property
    def best(self) -> dict:
        return self.settings[self.accuracies.index(max(self.accuracies))]

    def table(self, df: DataFrame) -> DataFrame:
        """(setting, accuracy): as many rows as the grid has settings."""
        rows = [(", ".join(f"{k}={v}" for k, v in s.items()), a) for s, a in zip(self.settings, self.accuracies, strict=True)]
        return df.sparkSession.createDataFrame(rows, "setting string, accuracy double")


def settings_of(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _groups(kind: str, grid: Mapping[str, Sequence]) -> list[tuple[dict, list[dict]]]:
    """What is fitted once, and the values of the shared parameters that it serves."""
    shared = SHARED.get(kind, ())
    own = {name: values for name, values in grid.items() if name not in shared}
    served = {name: values for name, values in grid.items() if name in shared}
    return [(setting, settings_of(served)) for setting in settings_of(own)]


def _inputs(stages: Sequence[Estimator | Transformer]) -> list[str]:
    """The columns that stages read and none of them makes."""
    def named(stage: Estimator | Transformer, *params: str) -> list[str]:
        values = [stage.getOrDefault(p) for p in params if stage.hasParam(p) and stage.isDefined(p)]
        return [c for v in values for c in ([v] if isinstance(v, str) else v)]

    made = {c for s in stages for c in named(s, "outputCol", "outputCols")}
    return list(dict.fromkeys(c for s in stages for c in named(s, "inputCol", "inputCols") if c not in made))


def with_first_trees(rows: DataFrame, forest: JavaObject, counts: Sequence[int]) -> DataFrame:
    """Rows with the prediction of a fitted forest's first trees, for each wanted number of them (p0, p1, ...).

    The forest stays a JVM object: a Python model would wrap every one of its trees.
    """
    context = SparkContext._active_spark_context
    models, jvm_rows = context._jvm.org.apache.spark.ml.classification, rows._jdf
    for i, n in enumerate(counts):
        trees = context._gateway.new_array(models.DecisionTreeClassificationModel, n)
        context._jvm.java.lang.System.arraycopy(forest.trees(), 0, trees, 0, n)
        part = models.RandomForestClassificationModel(f"{forest.uid()}_{n}", trees, forest.numFeatures(), forest.numClasses())
        part.setFeaturesCol(FEATURES)
        part.setRawPredictionCol("")
        part.setProbabilityCol("")
        part.setPredictionCol(f"p{i}")
        jvm_rows = part.transform(jvm_rows)
    return DataFrame(jvm_rows, rows.sparkSession)


def _judged(train: DataFrame, held_out: DataFrame, kind: str, setting: Mapping, served: Sequence[Mapping],
            seed: int) -> Iterator[tuple[dict, float]]:
    """Accuracy of every setting that one group of fits serves, from one pass over the held-out rows."""
    if served[0] and kind != "logistic":
        largest = {name: max(s[name] for s in served) for name in served[0]}
        estimator = learning.classifier(kind, seed, **largest, **setting, **GROWN[kind])
        forest = estimator._fit_java(train)
        sizes = [(s.get("numTrees", estimator.getNumTrees()), s.get("maxDepth", estimator.getMaxDepth())) for s in served]
        if len({depth for _, depth in sizes}) == 1:
            rows = with_first_trees(held_out, forest, [n for n, _ in sizes])
            predictions = [F.col(f"p{i}") for i in range(len(sizes))]
        else:
            rows = with_smaller_forests(held_out, forest, sizes)
            predictions = [F.col("predictions")[i] for i in range(len(sizes))]
    else:
        model = learning.classifier(kind, seed, **setting).fit(train)
        rows = model.transform(held_out)
        score = vector_to_array("probability")[1] if served[0] else None
        predictions = [(score > s["threshold"]).cast("int") if s else F.col("prediction") for s in served]
    right = rows.agg(*[F.avg((p == F.col(LABEL)).cast("double")).alias(f"a{i}") for i, p in enumerate(predictions)]).first()
    for i, s in enumerate(served):
        yield {**setting, **s}, right[i] or 0.0


def search(df: DataFrame, stages: Sequence, kind: str, grid: Mapping[str, Sequence], indexer: StringIndexerModel,
           key: str, folds: int = FOLDS, parallelism: int = 8, seed: int = 0, leak_free: bool = True) -> Search:
    """Try every setting of a grid in every fold and refit the best one on all rows.

    A hash of ``key`` deals the folds. ``leak_free`` refits the feature stages in every
    fold; otherwise they are fitted once on all rows.
    """
    use_checkpoints(df.sparkSession)
    df = df.withColumn(FOLD, F.floor(unit_hash(F.col(key), seed, "fold") * folds).cast("int"))
    groups, scores = _groups(kind, grid), {}
    stages = [indexer, *stages]
    given = list(takewhile(lambda stage: not isinstance(stage, Estimator), stages))
    learned = Pipeline(stages=stages[len(given):])
    rows = PipelineModel(given).transform(df)
    rows = rows.select(LABEL, FOLD, *(_inputs(learned.getStages()) or [FEATURES]))

    def held(fold: int, vectors: DataFrame) -> None:
        train, held_out = vectors.where(F.col(FOLD) != fold), vectors.where(F.col(FOLD) == fold)

        def one(group: tuple[dict, list[dict]]) -> list[tuple[dict, float]]:
            return list(_judged(train, held_out, kind, *group, seed))

        # As many groups at a time as threads, each with job properties of its own.
        tasks = [inheritable_thread_target(df.sparkSession)(partial(one, group)) for group in groups]
        with ThreadPool(min(parallelism, len(groups))) as pool:
            for found in pool.map(lambda task: task(), tasks, chunksize=1):
                for setting, accuracy in found:
                    scores.setdefault(tuple(sorted(setting.items())), []).append(accuracy)

    with cached(rows):
        fitted = None if leak_free else learned.fit(rows)
        for fold in range(folds):
            stage = fitted or learned.fit(rows.where(F.col(FOLD) != fold))
            vectors = stage.transform(rows).select(LABEL, FEATURES, FOLD)
            with cached(vectors):
                held(fold, vectors)
        settings = settings_of(grid)
        means = [sum(s) / len(s) for s in (scores[tuple(sorted(x.items()))] for x in settings)]
        best = settings[means.index(max(means))]
        stage = fitted or learned.fit(rows)
        vectors = stage.transform(rows).select(LABEL, FEATURES)
        with cached(vectors):
            model = learning.classifier(kind, seed, **best, **GROWN.get(kind, {})).fit(vectors)
    return Search(PipelineModel([*given, *stage.stages, model, learning.label_names(indexer)]), settings, means)
