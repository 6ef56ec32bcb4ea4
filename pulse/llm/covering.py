"""SimHash bits and covering locality-sensitive hashing.

Covering: every bit position gets a non-zero vector of GF(2)^(r+1). A table
exists for each non-zero vector v; its mask holds the positions whose vector
has an odd product with v. The vectors of any r positions span at most r
dimensions, so some v is orthogonal to all of them: that table's mask leaves
these positions out, and a pair that differs there only meets in it. With r = 2
seven tables are enough, without any chance of a miss.

Inside a table two fingerprints of one bucket can differ in unmasked positions
only. Buckets of two, the usual accident, are judged from their smallest and
largest member. In larger buckets each member sends itself and its neighbours
at one flipped, unmasked bit: two members are linked exactly if they share one
of these points. No point is reached by more than 65 fingerprints, so even a
bucket that holds a third of the corpus is spread over as many small groups as
it has members and never paired up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, RADIUS = 64, 2


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero vector of GF(2)^(radius + 1)."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [i % len(vectors) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of_bit[i] & v).bit_count() % 2) for v in vectors]


def majority(digests: np.ndarray) -> int:
    """The bits that over half of the digests (rows of eight bytes) have set."""
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(digests), 255):  # 255 votes fit into a byte
        votes += np.unpackbits(digests[start:start + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big")


def links(fps: DataFrame) -> DataFrame:
    """Linked pairs (a, b) that connect all fingerprints within the radius.

    ``fps`` has one column ``fp`` of different values. Every true link joins two
    values of one component of the result, and every pair of the result is
    within the radius or shares a neighbour with which both are.
    """
    masks = covering_masks()
    tables = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key"))
        for i, mask in enumerate(masks)])).alias("b")).select("fp", "b.t", "b.key")
    buckets = tables.groupBy("t", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = buckets.where(f"n = 2 and bit_count(a ^ b) <= {RADIUS}").select("a", "b")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[
        F.lit(signed(1 << i)) for i in range(BITS) if not mask >> i & 1]) for mask in masks])
    points = (
        tables.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
        .select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        .agg(F.collect_set("fp").alias("members"))  # at most 65
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    )
    return pairs.union(points).distinct()
