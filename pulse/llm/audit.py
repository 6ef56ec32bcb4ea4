"""How filters act on each other: which order removes what, and each filter's Shapley share.

A filter order walks through the lattice of filter subsets, from the empty set to
the full one. What filter f removes at a step depends only on the set S of filters
applied before it: the documents that fail f and none of S. So

1. each document becomes a set of failed filters, and documents are counted by
   part and set (at most 2^n rows a part, whatever the number of documents);
2. the counts give the removals of each edge S -> S + f of the lattice;
3. a forward pass counts the orders that reach each S, a backward pass those that
   lead on from S + f. Their product is the number of orders through the edge;
   removals weighted by it add up to the filter's sum over all orders (Shapley);
4. the steps of a single order are read from the same edges.

Documents that equal one with a smaller id are found by a digest of the text, and
documents with the same text have the same set but for this filter: it is enough to
know how many documents of a text have its least id. Rows with the same id are never
smaller than each other, rows without an id neither fail nor make others fail. Null
texts are empty, null parts are the empty string. Rows of ``labels`` for one id are
put together by their maximum; labels without an id mark nothing. An empty table has
no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import staged

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A too few words, B too few different words, C capitals, D symbols."""
    def on_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct((n < 100).alias("A"), (F.size(F.array_distinct(w)) * 100 < n * 80).alias("B"))

    # A list of one binds the words: the text is split once for both filters.
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    judged = F.get(F.transform(F.array(words), on_words), 0)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"words": judged, "C": capitals * 100 > F.char_length(text) * 10, "D": text.rlike(r"[#$%&*|]")}


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(set, filter, orders through this edge) of all edges, sets as bits; 2^n is the number of states."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(full + 1)):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return [(state, f, reach[state] * leave[state | 1 << f])
            for state in range(full + 1) for f in range(n) if not state >> f & 1]


def edge_counts(cells: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, paths, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of each edge.

    ``cells`` has one row for each part and set of failed filters (``mask``), with the
    numbers of documents, good ones and toxic ones.
    """
    edges = F.explode(F.array(*[F.struct(
        F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(p).cast("long").alias("paths"))
        for s, f, p in lattice(n)]))
    rows = cells.select("*", edges.alias("edge")).select("*", "edge.*")
    bit = F.col("bit")
    fails = F.col("mask").bitwiseAND(bit) != 0
    before = F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(column: str, condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).alias(name)

    return rows.groupBy("part", "state", "filter", "paths").agg(
        total("n", ~fails & ~before, "kept"), total("n", fails & ~before, "removed"),
        total("n", fails & before, "redundant"), total("n", F.col("mask") == bit, "unique_fails"),
        total("good", fails & ~before, "good_lost"), total("toxic", fails & ~before, "toxic_lost"))


def order_steps(edges: DataFrame, names: str) -> DataFrame:
    """Each step of each order of the filters, with the filter's sum over all orders, per part.

    Orders and steps are a table of n! * n rows that depends on the filters alone.
    """
    spark = edges.sparkSession
    steps = [("".join(order), step + 1, sum(1 << names.index(f) for f in order[:step]), names.index(order[step]))
             for order in permutations(names) for step in range(len(names))]
    table = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return edges.join(F.broadcast(table), ["state", "filter"]).join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters, A the lowest bit, E the fifth."""
    text = F.coalesce("text", F.lit(""))
    facts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    facts = facts.select("doc_id", "part", F.md5("text").alias("digest"), F.struct(
        *[c.alias(name) for name, c in text_filters(F.col("text")).items()]).alias("f"))
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(
        (F.col("f.words.A"), F.col("f.words.B"), F.col("f.C"), F.col("f.D")))), F.lit(0))
    # The texts are read once; from here on rows have a hundred bytes.
    facts = staged(facts.select("doc_id", "part", "digest", mask.alias("mask")), "audit-facts")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # Rows without an id, of which there may be many, have no labels and take no part in the join.
    known = facts.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    unknown = facts.where(F.col("doc_id").isNull()).select(
        "doc_id", "digest", "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    kind = ("digest", "part", "mask", "good", "toxic")
    # Rows of one id and text are counted first; then the least id of a text comes with the number of its rows.
    ids = known.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n")).unionByName(
        unknown.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n")))
    texts = ids.groupBy(*kind).agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.sum("n").alias("n"))
    # A text has as many rows here as it has parts and labels.
    first = texts.groupBy("digest").agg(
        F.min("least.doc_id").alias("first"), F.collect_list(F.struct(*kind[1:], "least", "nameless", "n")).alias("rows"))
    rows = first.select("first", F.inline("rows"))
    spared = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.inline(F.array(
        F.struct(F.col("mask").alias("set"), spared.alias("m")),
        F.struct((F.col("mask") + 16).alias("set"), (F.col("n") - spared).alias("m"))))
    return rows.select("part", "good", "toxic", both).where("m > 0").groupBy(
        "part", F.col("set").alias("mask")).agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"),
        F.sum(F.col("m") * F.col("toxic")).alias("toxic"))


def audit_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of all 120 orders of the filters A to E, for each value of lang."""
    cells = staged(failed_sets(docs, labels), "audit-cells")
    return order_steps(staged(edge_counts(cells, 5), "audit-edges"), "ABCDE")


AUDIT_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (
    SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good,
        coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), facts AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        map(['A', 'B', 'C', 'D', 'E'], [
            len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
            100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(words.doc_id > first, false)]) AS fails
    FROM words JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), sets AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM facts GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[:step - 1], '') AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
    SELECT *, element_at(fails, f)[1] AS here,
        len(list_filter(earlier, lambda x: x <> '' AND element_at(fails, x)[1])) > 0 AS gone,
        len(list_filter(map_values(fails), lambda x: x)) = 1 AS alone
    FROM sets, steps
), counted AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT here AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (here AND alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
