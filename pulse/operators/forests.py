"""Smaller forests inside a fitted one: its first trees, cut at a depth.

How a node is split does not depend on how deep its tree may grow, so a tree cut at a depth is
a tree grown to that depth. MLlib merges two leaves that predict the same class when a tree is
done; that is repeated after the cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.operators.learning import FEATURES
from pulse.session import scratch_path

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def leaf_votes(nodes: pd.DataFrame, depths: Sequence[int]) -> np.ndarray:
    """Shares of the classes, by leaf, depth and class, of the node of one tree where a row of that leaf
    ends when the tree is cut at the depth.

    A saved tree numbers its nodes from the root, a parent before its children and left before right.
    """
    nodes = nodes.sort_values("id")
    left, right, predicted = (nodes[c].to_numpy().astype(int) for c in ("leftChild", "rightChild", "prediction"))
    is_leaf = left < 0
    inner = np.flatnonzero(~is_leaf)
    depth = np.zeros(len(nodes), int)
    for i in inner:
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    counts = np.array(nodes["impurityStats"].tolist(), float)
    totals = counts.sum(axis=1, keepdims=True)
    shares = np.divide(counts, totals, out=np.zeros_like(counts), where=totals > 0)
    found = []
    for limit in depths:
        # the one class that all leaves below a node predict, or -1
        only = np.where(is_leaf | (depth >= limit), predicted, -1)
        for i in inner[::-1]:
            if depth[i] < limit and only[left[i]] == only[right[i]]:
                only[i] = only[left[i]]
        end = np.arange(len(nodes))
        for i in inner:
            if only[i] >= 0 or end[i] != i:
                end[left[i]] = end[right[i]] = end[i]
        found.append(shares[end[is_leaf]])
    return np.stack(found, axis=1)


def all_votes(rows: DataFrame, forest: JavaObject, depths: Sequence[int]) -> list[np.ndarray]:
    """:func:`leaf_votes` of every tree of a fitted forest, in its order. A model's size, whatever the rows."""
    spark, classes = rows.sparkSession, forest.numClasses()
    path = scratch_path(spark, "forest")
    forest.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild")

    def votes(tree: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": tree["treeID"].iloc[:1], "votes": [leaf_votes(tree, depths).tobytes()]})

    found = nodes.groupBy("treeID").applyInPandas(votes, "tree int, votes binary").collect()
    return [np.frombuffer(row.votes).reshape(-1, len(depths), classes) for row in sorted(found, key=lambda r: r.tree)]


def with_smaller_forests(rows: DataFrame, forest: JavaObject, wanted: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows with the array ``predictions`` of a fitted forest's first trees cut at a depth, for each wanted
    (number of trees, depth). As in MLlib, a tree votes with the shares of its leaf and the first of equal classes wins."""
    depths = sorted({depth for _, depth in wanted})
    trees = all_votes(rows, forest, depths)
    votes = np.concatenate(trees)
    first = np.cumsum([0, *map(len, trees[:-1])])

    @F.pandas_udf("array<int>")
    def predictions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for leaves in batches:
            at = first + np.stack(leaves.to_numpy()).astype(int)
            found = np.empty((len(at), len(wanted)), np.int32)
            for j, depth in enumerate(depths):
                sums = votes[at, j].cumsum(axis=1)
                for i, (n, limit) in enumerate(wanted):
                    if limit == depth:
                        found[:, i] = sums[:, n - 1].argmax(axis=1)
            yield pd.Series(list(found))

    forest.setFeaturesCol(FEATURES)
    forest.setLeafCol("leaves")
    scored = DataFrame(forest.transform(rows._jdf), rows.sparkSession)
    return scored.withColumn("predictions", predictions(vector_to_array("leaves")))
