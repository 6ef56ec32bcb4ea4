"""Repeatable pseudo-random numbers taken from a key.

``rand`` and ``DataFrame.sample`` depend on how rows are spread over
partitions. A number taken from the key itself is the same on every run, on
every cluster and after any retry of a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(16 ** 8)


def unit_hash(key: Column, seed: int = 0, stream: str = "sample") -> Column:
    """A number in [0, 1) from a key, a seed and a stream; NULL for a NULL key.

    Every use of the hash has a stream of its own: a row that a sample kept is
    still dealt evenly over the parts of a split with the same seed.
    """
    digest = F.md5(F.concat(F.lit(f"{stream}:{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_RANGE)
