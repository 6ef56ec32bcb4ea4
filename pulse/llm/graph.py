"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.session import use_checkpoints


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. a < b in every row.

    The row of the smallest neighbour links the node, the rows of the others link these.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return edges.join(least, "b").select(
        F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b with a < b): root is the smallest node reachable.

    Alternates large-star and small-star steps. Only links are kept, never
    groups, so a hub's links are spread by the join like any skewed key. Each
    step is a reliable checkpoint in the shared folder: its table is read twice by the
    next one, so one plan for both steps would hold the first one over again.
    """
    use_checkpoints(edges.sparkSession)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = _small_star(_large_star(edges).checkpoint()).checkpoint()
    own = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(own)
