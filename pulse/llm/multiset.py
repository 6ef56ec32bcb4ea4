"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph is a shortest stretch that ends with a line break or with a sentence
end followed by space. Each is hashed to a wide vector, and a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo a power of two. The sum
does not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its vector (``combined``).

Lanes: a counter of paragraphs (mod 2^48); ``DENSE`` lanes that every paragraph
fills with 48 random bits (mod 2^48), so that different multisets differ; and
``LEVELS`` times ``SPARSE`` lanes (mod 2^16), of which a paragraph touches a single
one with a random non-zero value. Its level is l with probability 3/4^(l + 1) (the last
level takes what is left), by its hash. In the difference of two fingerprints a sparse
lane stays zero only if no paragraph in which the texts differ touches it (up to one in
2^16). With d such paragraphs at a level a share (1 - 1/SPARSE)^d of its lanes stays zero,
which gives d. Levels with fewer than ``OPEN`` zero lanes are full: their paragraphs are
counted from the levels above, of which these are a known share. From the lowest
level that is not full on, the sum divided by the share 1/4^l of paragraphs there gives
d for the whole text, with the likeness 1 - d / (paragraphs of both): the share of common
paragraphs. Twelve levels are not full below a thousand million differing paragraphs,
more than a text can hold; the estimate of d is good to some 10 to 15 % at any size.
Sparse lanes are kept as the sorted list of those that are not zero, at most one for
each paragraph.

Null and empty texts have no paragraphs and the zero fingerprint; two of them
are wholly alike. Next documents follow descending doc_id, after the last the
first one; rows with equal doc_id follow each other by a hash of their text, and
null doc_ids come last. Rows with equal doc_id and text are one document, returned
as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import staged

DENSE, SPARSE, LEVELS = 4, 128, 12
#: Zero lanes that a level needs to be read.
OPEN = 14
_WIDE, _NARROW = (1 << 48) - 1, (1 << 16) - 1
#: An entry is a lane's number times _LANE and a sum of values; the sum has room for 2^24 values.
_SUM_BITS = 40
_LANE = 1 << _SUM_BITS
#: What stays of an entry: the sign, the lane and the sum modulo 2^16.
_KEPT = -_LANE | _NARROW
_LEVEL_BITS = (1 << 2 * (LEVELS - 1)) - 1
#: The first space after a sentence end, with those that follow, or a line break.
PARAGRAPH_END = r"\x20(?<=[.!?]\x20)\x20*|\n"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text without blank ones."""
    return F.filter(F.split(text, PARAGRAPH_END, -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _vector(paragraph: Column) -> Column:
    """Dense lanes d0, d1, ... and the entry (number of the sparse lane, value) of one paragraph."""
    dense = [F.shiftrightunsigned(F.xxhash64(F.lit(i), paragraph), 16) for i in range(DENSE)]

    def entry(h: Column) -> Column:
        # Pairs of zero bits at the end of a hash: each further pair is four times as rare.
        low = h.bitwiseAND(_LEVEL_BITS)
        zeros = F.bit_count(low.bitwiseAND(-low) - 1).cast("int")
        level = F.when(low == 0, LEVELS - 1).otherwise(F.shiftright(zeros, 1))
        lane = F.shiftrightunsigned(h, 2 * (LEVELS - 1)).bitwiseAND(SPARSE - 1)
        return (level * SPARSE + lane) * _LANE + F.shiftrightunsigned(h, 32) % _NARROW + 1

    return F.struct(*[d.alias(f"d{i}") for i, d in enumerate(dense)],
                    _bound(F.xxhash64(F.lit("sparse"), paragraph), entry).alias("entry"))


def _added(entries: Column) -> Column:
    """Entries sorted by lane, those of one lane added, without lanes that are zero."""
    def add(s: Column, entry: Column) -> Column:
        same = F.shiftright(entry, _SUM_BITS) == F.shiftright(s["last"], _SUM_BITS)
        return F.when(same, F.struct(s["done"].alias("done"), (s["last"] + entry.bitwiseAND(_LANE - 1)).alias("last"))).otherwise(
            F.struct(F.array_append(s["done"], s["last"]).alias("done"), entry.alias("last")))

    zero = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("long").alias("last"))
    sums = F.aggregate(F.sort_array(entries), zero, add, lambda s: F.array_append(s["done"], s["last"]))
    return F.filter(
        F.transform(sums, lambda e: e.bitwiseAND(_KEPT)), lambda e: (e >= 0) & (e.bitwiseAND(_NARROW) != 0))


def fingerprint(text: Column) -> Column:
    """Struct of the counter, the dense lanes, and the entries of the sparse lanes that are not zero, sorted."""
    names = [f"d{i}" for i in range(DENSE)]
    zero = F.struct(*[F.lit(0).cast("long").alias(d) for d in names])

    def summed(vectors: Column) -> Column:
        dense = F.aggregate(
            vectors, zero, lambda s, v: F.struct(*[(s[d] + v[d]).bitwiseAND(_WIDE).alias(d) for d in names]),
            lambda s: F.array(*[s[d] for d in names]))
        return F.struct(F.size(vectors).cast("long").alias("n"), dense.alias("dense"),
                        _added(F.transform(vectors, lambda v: v["entry"])).alias("sparse"))

    return _bound(F.transform(paragraphs(text), _vector), summed)


def combined(one: Column, other: Column, sign: int = 1) -> Column:
    """Fingerprint of both texts' paragraphs together, or with -1 of one without the other's."""
    def wide(a: Column, b: Column) -> Column:
        return (a + b if sign > 0 else a - b).bitwiseAND(_WIDE)

    def turned(entry: Column) -> Column:
        return entry if sign > 0 else entry - 2 * entry.bitwiseAND(_NARROW) + _NARROW + 1

    return F.struct(
        wide(one["n"], other["n"]).alias("n"), F.zip_with(one["dense"], other["dense"], wide).alias("dense"),
        _added(F.concat(one["sparse"], F.transform(other["sparse"], turned))).alias("sparse"))


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of common paragraphs, from two fingerprints alone."""
    def levels_of(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.shiftright(e, _SUM_BITS))

    differing_lanes = F.array_union(
        levels_of(F.array_except(one["sparse"], other["sparse"])), levels_of(F.array_except(other["sparse"], one["sparse"])))
    counted = F.transform(differing_lanes, lambda lane: F.floor(lane / SPARSE).cast("int"))
    zeros = _bound(counted, lambda c: F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: SPARSE - F.size(F.filter(c, lambda level: level == k))))
    # From the last level down: what the levels so far hold, until one is full.
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("d"), F.lit(False).alias("full"))

    def down(state: Column, zero: Column, share: Column) -> Column:
        here = F.log(F.greatest(zero, F.lit(0.5)) / SPARSE) / F.log(F.lit(1 - 1 / SPARSE))
        full = state["full"] | ((zero < OPEN) & (share < 4.0 ** (LEVELS - 1)))
        held = state["held"] + here
        return F.named_struct(F.lit("held"), held, F.lit("d"), F.when(full, state["d"]).otherwise(held * share), F.lit("full"), full)

    levels = F.reverse(F.transform(zeros, lambda z, k: F.named_struct(
        F.lit("zero"), z, F.lit("share"), F.pow(F.lit(4.0), k))))
    differing = F.aggregate(levels, start, lambda s, x: down(s, x["zero"], x["share"]), lambda s: s["d"])
    both = one["n"] + other["n"]
    estimate = F.greatest(F.lit(0.0), F.lit(1.0) - differing / F.nullif(both, F.lit(0)))
    return F.when(one == other, 1.0).when(both == 0, 1.0).otherwise(estimate)


def fingerprint_text(print_: Column) -> Column:
    """Hexadecimal form: 12 digits for the counter and each wide lane, 7 for each sparse lane (3) and its value (4)."""
    def digits(values: Column, width: int) -> Column:
        return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), width, F.lit("0")))), "")

    short = F.transform(print_["sparse"], lambda e: F.shiftright(e, _SUM_BITS - 16) + e.bitwiseAND(_NARROW))
    return F.concat(digits(F.concat(F.array(print_["n"]), print_["dense"]), 12), digits(short, 7))


def neighbours(unique: DataFrame) -> DataFrame:
    """(did, key, doc_id, times, previous_did, previous_key, previous_chars) along descending doc_id.

    Ids alone are dealt into ranges and written, once; inside a range a window
    finds the neighbours, and the ends of the ranges, a row for each, are linked
    to each other.
    """
    spark = unique.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(unique.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "id-ranges")
    me = F.struct("did", "key", "chars")
    inside = Window.partitionBy("part").orderBy(*order)
    linked = ranges.select("*", F.lag(me).over(inside).alias("previous"), F.lead("did").over(inside).alias("next_did"))
    # As many rows as shuffle partitions.
    ends = linked.groupBy("part").agg(F.max(F.when(F.col("next_did").isNull(), me)).alias("last"))
    around = Window.orderBy("part")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(around), F.last("last").over(whole)).alias("before"))
    both = linked.join(F.broadcast(ends), "part").select(
        "did", "key", "doc_id", "times", F.coalesce("previous", "before").alias("previous"))
    return both.select(
        "did", "key", "doc_id", "times", F.col("previous.did").alias("previous_did"),
        F.col("previous.key").alias("previous_key"), F.col("previous.chars").alias("previous_chars"))


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next text's are."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    # Gathered once with its fingerprint: both uses below share one shuffle of the texts.
    unique = rows.groupBy("did", "key").agg(F.first(F.struct("text", fingerprint(F.col("text")).alias("lanes"))).alias("t")).select(
        "did", "key", "t.*")
    links = neighbours(rows.groupBy("doc_id", "did", "key", F.char_length("text").alias("chars")).agg(
        F.count(F.lit(1)).alias("times")))
    # Each text once with the document before it, for which it is the next one.
    heads = unique.join(
        links.select("did", "key", "previous_did", "previous_key", "previous_chars"), ["did", "key"]).select(
        F.col("previous_did").alias("did"), F.col("previous_key").alias("key"),
        F.substring(F.col("text"), F.lit(1), F.floor(F.col("previous_chars") / 3).cast("int")).alias("head"),
        F.col("lanes").alias("next_lanes"))
    chars = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - F.floor(chars / 3).cast("int")), F.col("head"))
    whole = (
        unique.join(links.select("did", "key", "doc_id", "times"), ["did", "key"]).join(heads, ["did", "key"])
        .withColumn("edited", edited).withColumn("edited_lanes", fingerprint(F.col("edited")))
    )
    return whole.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("lanes")).alias("fingerprint"),
        fingerprint_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
