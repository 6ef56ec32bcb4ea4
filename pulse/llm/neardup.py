"""Groups of texts that share four fifths of their five-word shingles.

A document is the set of its different word shingles (a text with fewer words is
one shingle). Two documents are near copies if the Jaccard likeness of their sets
is ``LIKE`` or more, and a group is what near copies reach through each other.

Equal sets are one node. Candidates come first from SimHash: the majority bits of the
hashes of a set, met by covering tables (``covering``) at two or fewer differing bits. A
likeness of 0.8 leaves some ten bits, so this alone finds near copies with few edits only.
The others come from ``BANDS`` independent keys, each made of ``ROWS`` minimum hashes of the set: two sets of likeness 0.8 share
none of them with probability (1 - 0.8^3)^20, below one in a million. Every
candidate pair of either kind is compared by the sorted hashes of its shingles, so no link rests on a fingerprint.

A bucket that still lies in several groups is first compared with its smallest member, then with others chosen by a
hash as long as these find links: a bucket full of near copies of one text costs a few
pairs for each member, not one for each two of them. Texts of buckets that then still lie in several groups are few
near copies among texts that have much in common (a shared passage, say). These meet
by their rarest shingles: of all shingles of a set, ordered by the number of such texts
that have them, a set of n shingles and one of m share one among the first
n - 4 (n + m) / 9 and the first m - 4 (n + m) / 9, or they are not alike. Keys are a shingle
and both sizes (in classes of ``STEP``), so a shared passage is no key, and only texts
outside a key's largest group are paired with the others.

Nulls and texts without a word have the empty set and are near copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType
from xxhash import xxh3_128_digest, xxh64_digest

from pulse.llm.common import raw, staged
from pulse.llm.covering import links as covering_links, majority, signed
from pulse.llm.graph import connected

SHINGLE, BANDS, ROWS, SEED = 5, 20, 3, 42
#: Likeness of near copies, as a fraction so that it is compared exactly.
LIKE = (4, 5)
#: Sizes are told apart exactly up to ``EXACT`` shingles, in classes that grow by ``STEP`` above.
EXACT, STEP = 50, 1.02
_RNG = np.random.default_rng(SEED)
_MIX, _TIMES = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_JOIN = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, grams)), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each group of ``ROWS`` minimum hashes; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        part = hashes[None, start:start + 2048]
        least = np.minimum(least, ((part ^ _MIX) * _TIMES).min(axis=1))
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, as a signed long."""
    return signed(majority(hashes.view(np.uint8).reshape(-1, 8)))


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether the Jaccard likeness of two sets is LIKE or more."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common * LIKE[1] >= LIKE[0] * (len(one) + len(other) - common)


@F.pandas_udf(StructType([
    StructField("node", BinaryType()), StructField("n", IntegerType()), StructField("fp", LongType()),
    StructField("bands", ArrayType(LongType()))]))
def _sketch(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        hashes = shingles(t)
        rows.append((xxh3_128_digest(hashes.tobytes()), len(hashes), fingerprint(hashes), bands(hashes)))
    return pd.DataFrame(rows, columns=["node", "n", "fp", "bands"])


@F.pandas_udf(BinaryType())
def _hashes(text: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in text], dtype=object)


@F.pandas_udf(BooleanType())
def _alike(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                      for a, b in zip(one, other, strict=True)], dtype=bool)


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, n, key, root) of the members of buckets."""
    return members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _size_allows(n: str, other: str) -> Column:
    return F.least(n, other) * LIKE[1] >= F.greatest(n, other) * LIKE[0]


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that connect nodes of equal and of linked fingerprints, if they may be alike by size.

    The smallest node of a fingerprint stands for it, so a fingerprint of many nodes has one pair for each.
    """
    first = staged(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("y")), "near-fingerprints")
    equal = nodes.join(first, "fp").where(F.col("node") != F.col("y.node")).select("node", "n", "y")
    linked = covering_links(first.select("fp"))
    ends = [first.select(F.col("fp").alias(end), F.col("y").alias(f"{end}_y")) for end in ("a", "b")]
    across = linked.join(ends[0], "a").join(ends[1], "b").select("a_y.node", "a_y.n", F.col("b_y").alias("y"))
    return equal.union(across).where(_size_allows("n", "y.n")).select(*_pair("node", "y.node")).distinct()


def _with_representatives(members: DataFrame, labels: DataFrame, step: int) -> DataFrame | None:
    """Pairs (a, b), a < b, of each member and one of its bucket, if they are not in one group and may be alike by size.

    None if every bucket lies in one group.
    """
    rows = _rooted(members, labels)
    mixed = F.col("node") if step == 0 else F.xxhash64(F.lit(step), "node", "key")
    mixed_keys = staged(rows.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("node", "n", "root"), mixed).alias("y"))
        .where("lo <> hi").select("key", "y"), "near-open")
    if mixed_keys.isEmpty():
        return None
    both = rows.join(mixed_keys, "key").where(F.col("root") != F.col("y.root"))
    return both.where(_size_allows("n", "y.n")).select(*_pair("node", "y.node")).distinct()


def _size_class(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(
        EXACT + F.ceil(F.log(n / EXACT) / F.log(F.lit(STEP)))).cast("int")


def _rare_shingles(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, root, h, at): the rarest shingles of the texts of open buckets, with their places in this order.

    Shingles that no other of these texts has come first, and are left out.
    """
    rows = _rooted(members, labels)
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    nodes = staged(rows.join(keys, "key", "left_semi").select("node", "n", "root").distinct(), "near-open-nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                h = np.frombuffer(batch["set"][at].as_py(), np.int64)
                for part in np.array_split(h, len(h) // 50_000 + 1):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch["node"][at].as_py()] * len(part), pa.binary()), pa.array(part)], ["node", "h"])

    own = staged(sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(spread, "node binary, h long"),
                 "near-shingles")
    shared = staged(own.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-shared")
    # A row for each text: its shared shingles, at most as many as it has words.
    ordered = own.join(shared, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    most = F.col("n") - F.ceil(F.col("n") * LIKE[0] / LIKE[1]) + 1
    return ordered.join(nodes, "node").withColumn("alone", F.col("n") - F.size("s")).withColumn(
        "s", F.slice("s", F.lit(1), F.greatest(F.lit(0), most - F.col("alone")).cast("int"))).select(
        "node", "n", "root", "alone", F.posexplode("s").alias("at", "e")).select(
        "node", "n", "root", F.col("e.h").alias("h"), (F.col("alone") + F.col("at")).alias("at"))


def _by_rare_shingles(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of different groups of which shingles and sizes allow that they are alike."""
    rare = staged(_rare_shingles(members, labels, sets), "near-rare")
    # Shingles that are rare in texts of several groups; this leaves few rows for the sizes below.
    meeting = rare.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rare = staged(rare.join(meeting, "h", "left_semi"), "near-rare")
    num, den = LIKE  # alike: common * (num + den) >= num * (n + m)
    n = F.col("n")
    # The largest size of the other set for which this place is early enough.
    reach = F.floor((n - F.col("at")) * (num + den) / num - n)

    def keyed(low: Column, high: Column, mine_first: bool) -> DataFrame:
        other = F.explode(F.sequence(_size_class(low), _size_class(high)))
        own = rare.where(low <= high).select("*", _size_class(n).alias("own"), other.alias("other"))
        pair = ("own", "other") if mine_first else ("other", "own")
        return own.select("node", "n", "root", "at", F.xxhash64("h", *pair).alias("key"))

    short = keyed(n, F.least(reach, F.floor(n * den / num)), True)
    long = keyed(F.ceil(n * num / den), F.least(reach, n), False)
    main = staged(short.union(long).groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max_by("root", "m").alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main"),
        "near-main")
    short, long = (staged(side.join(main, "key"), "near-keyed") for side in (short, long))
    other = long.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "root", "at", "main")])
    room = F.least(n - F.col("at"), F.col("other_n") - F.col("other_at"))
    may = (F.col("root") != F.col("other_root")) & (room * (num + den) >= (n + F.col("other_n")) * num)
    pairs = [mine.join(theirs, "key").where(may).select(*_pair("node", "other_node")) for mine, theirs in (
        (short.where("root <> main"), other), (short.where("root = main"), other.where("other_root <> other_main")))]
    return pairs[0].union(pairs[1]).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root) for each row: the hash of its text and what names its group."""
    sketch = docs.select("doc_id", F.xxhash64("text").alias("key"), _sketch(raw()).alias("s"))
    prints = staged(sketch.select("doc_id", "key", "s.*"), "near-sets")
    nodes = staged(prints.groupBy("node").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
        F.min(F.struct("doc_id", "key")).alias("place")), "near-nodes")
    tables = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = staged(tables.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "near-keys")
    members = staged(tables.join(shared, "key", "left_semi"), "near-buckets")
    near = staged(_by_fingerprint(nodes.select("fp", "node", "n")), "near-bits")
    # One text of each node that meets another one.
    meeting = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    wanted = nodes.join(meeting, "node", "left_semi").select(
        "node", F.col("place.doc_id").alias("id"), F.col("place.key").alias("key"))
    source = docs.select("doc_id", raw())
    sets = staged(source.join(wanted, source["doc_id"].eqNullSafe(wanted["id"]) & (
        F.xxhash64(source["text"].cast("string")) == wanted["key"])).select("node", "text").dropDuplicates(["node"]).select(
        "node", _hashes("text").alias("set")), "near-texts")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "other"), "b")
        return staged(both.where(_alike("one", "other")).select("a", "b"), "near-links")

    labels = staged(connected(compared(near)), "near-labels")
    step, useful = 0, True
    while True:
        # Representatives go on as long as they link one in twenty pairs; the rest is met by rare shingles, once.
        found = _with_representatives(members, labels, step) if useful else _by_rare_shingles(members, labels, sets)
        if found is None:
            break
        pairs = staged(found, "near-pairs")
        links = compared(pairs)
        # A group so far is its smallest node, linked to all others: these links say as much as those that made it.
        known = labels.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))
        labels = staged(connected(known.union(links)), "near-labels")
        if not useful:
            break
        useful = links.count() * 20 >= pairs.count()
        step += 1
    known = staged(nodes.select("node").join(labels, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")), "near-groups")
    return prints.select("doc_id", "key", "node").join(known, "node").select("doc_id", "key", "root")
