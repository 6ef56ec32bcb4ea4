"""Repeated runs of lines, found by winnowing.

Lines with a word are numbered from 0 in each document. Of every ``RUN`` such
lines in a row the smallest line hash is selected (the last of equal ones): any
two places that share RUN lines select the same line there, so a run shared by
two places always meets in a selected fingerprint. Only windows whose
fingerprint is selected in two places or more go on. They are compared by a
128-bit hash of their lines with the first window of that content, by
(doc_id, hash of the text, line): matching windows that overlap join up to the
longest match on both sides of the fingerprint. All lines of a later window go.

In short: a line is deleted if some RUN lines in a row around it also stand at
an earlier place. First occurrences and single shared lines stay. No list of
places is ever gathered for a fingerprint: the first place is an aggregate, and
every other place is joined to it alone.

With ``long_words`` (the pipeline: ``LONG``) a single line or two lines in a row that
have more words than that are windows too, each its own fingerprint, and go if they
stand at an earlier place. The query has the plain rule, which its check SQL fixes.

Null texts stay null; empty texts, texts of blank lines and, without ``long_words``,
texts with fewer than RUN lines stay as they are; blank lines are never deleted. Rows with equal
doc_id and text are one document and are cut alike. A null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import replaced_text, staged

RUN = 3
#: A repeated passage of more words than these goes in the pipeline, however few lines it fills.
LONG = 50


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def _windows(docs: DataFrame, run: int, long_words: int | None = None) -> DataFrame:
    """One row for each window: its document, first line, fingerprint and content hash."""
    lines = F.filter(
        F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    hashed = (
        docs.where(F.length("text") > 0)
        .select("doc_id", text_key().alias("key"), lines.alias("lines"))
        .where(F.size("lines") >= (run if long_words is None else 1))
        .withColumn("h", F.transform("lines", lambda x: F.xxhash64(x["line"])))
    )

    def windows(size: int) -> Column:
        def window(i: Column) -> Column:
            here = F.slice("h", i + 1, size)
            texts = F.transform(F.slice("lines", i + 1, size), lambda x: x["line"])
            mark = F.array_min(here)
            return F.struct(
                i.alias("pos"), (mark if size == run else F.xxhash64(texts)).alias("mark"),
                (i + size - F.array_position(F.reverse(here), mark)).alias("selected"),
                F.xxhash64(texts).alias("w1"), F.xxhash64(F.lit("second"), texts).alias("w2"),
                F.transform(F.slice("lines", i + 1, size), lambda x: x["i"]).alias("at"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0))),
                                    lambda i: i + size <= F.size("lines")), window)

    found = hashed.select("doc_id", "key", windows(run).alias("w"))
    marked = found.select("doc_id", "key", F.explode(F.transform("w", lambda x, i: F.struct(
        x.alias("x"),
        ((i == 0) | (F.get("w", i - 1)["selected"] != x["selected"])).alias("fresh")))).alias("y")
    ).select("doc_id", "key", "y.x.*", "y.fresh")
    if long_words is None:
        return marked
    counted = hashed.withColumn("words", F.transform(
        "lines", lambda x: F.size(F.filter(F.split(x["line"], r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))))
    for size in range(1, run):
        long = counted.select("doc_id", "key", F.explode(windows(size)).alias("x"), "words").where(
            F.aggregate(F.slice("words", F.col("x.pos") + 1, size), F.lit(0), lambda n, w: n + w) > long_words)
        marked = marked.union(long.select("doc_id", "key", "x.*", F.lit(True)))
    return marked


def repeated_lines(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """(doc_id, key, cut): the line numbers to delete, for each document that has some."""
    windows = staged(_windows(docs, run, long_words), "line-windows")
    # Repeated fingerprints and contents are staged, so that the joins deal both sides anew and can split hot ones.
    marks = staged(windows.where("fresh").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"),
                   "line-marks")
    candidates = windows.join(marks, "mark", "left_semi")
    place = F.struct("doc_id", "key", "pos")
    first = staged(candidates.groupBy("w1", "w2").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-firsts")
    later = candidates.join(first, ["w1", "w2"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("cut"))


def _cut_text(docs: DataFrame, run: int, long_words: int | None = None) -> DataFrame:
    """docs with columns __kept (text or null) and __cut (line numbers or null)."""
    cuts = repeated_lines(docs, run, long_words).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("cut").alias("__cut"))
    joined = docs.join(
        cuts, docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(docs["text"]) == cuts["__key"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__cut"))
    split = joined.withColumn("__lines", F.when(F.col("__cut").isNotNull(), lines))
    return split.withColumn("__kept", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")))


def without_repeated_lines(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """The documents without the later occurrences of repeated runs of lines."""
    return replaced_text(_cut_text(docs, run, long_words), F.col("__kept")).select(*docs.columns)


def line_dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the SHA-256 of the kept text (null: empty)."""
    return _cut_text(docs.select("doc_id", "text"), RUN).select(
        "doc_id",
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1),
                        lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__cut"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = f"""
WITH lines AS (
    SELECT doc_id, i, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS wordy FROM (
        SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE wordy
), windows AS (
    SELECT doc_id, pos, count(*) OVER w AS n, list(line) OVER w AS content
    FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)
), later AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS k
        FROM windows WHERE n = {RUN}) WHERE k > 1
), gone AS (
    SELECT DISTINCT n.doc_id, n.i FROM later l JOIN numbered n
    ON n.doc_id = l.doc_id AND n.pos BETWEEN l.pos AND l.pos + {RUN - 1}
)
SELECT l.doc_id, count(*) FILTER (WHERE l.wordy) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY l.doc_id
"""
