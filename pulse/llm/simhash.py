"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the document's hashed word
shingles have it set. Two fingerprints are linked at ``RADIUS`` or fewer
differing bits.

The links come from covering tables (``covering``), without any chance of a miss.

Nulls and texts without a word have fingerprint zero and are linked like any
other. Rows that share a doc_id are one document for the component ids.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_digest

from pulse.llm.common import raw, staged
from pulse.llm.covering import covering_masks, links, majority, signed  # noqa: F401
from pulse.llm.graph import connected
from pulse.llm.neardup import groups

SHINGLE, SEED = 3, 42


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digests = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
    return majority(digests)


@F.pandas_udf(LongType())
def _fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(fingerprint, text), np.uint64, len(text)).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a long."""
    return docs.select("doc_id", _fingerprint(raw()).alias("fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links."""
    prints = staged(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    labels = connected(staged(links(nodes.select("fp")), "simhash-links"))
    joined = labels.join(nodes, labels["node"] == nodes["fp"]).select("node", "root", "first_doc")
    roots = joined.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    moved = joined.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    # Staged, so that the rows of a fingerprint with very many copies are dealt by the join alone and can be split.
    known = staged(nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_doc").alias("component_id")), "simhash-components")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (``neardup``): the smallest by doc_id, then by hash of the text.

    Rows without an id come after all others, so a group that has only such rows
    keeps one of them. Rows equal in doc_id and text stay once.
    """
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    kept = groups(docs).groupBy("root").agg(F.min(place).alias("place")).select(
        F.col("place.doc_id").alias("kept_id"), F.col("place.key").alias("kept_key")).distinct()
    marked = docs.withColumn("__key", F.xxhash64("text"))
    return (
        marked.join(kept, marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked["__key"] == kept["kept_key"]), "left_semi")
        .dropDuplicates(["doc_id", "__key"]).drop("__key")
    )
