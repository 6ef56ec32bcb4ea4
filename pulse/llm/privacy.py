"""Personal data: patterns, and terms that give protected entities away.

Base spans are the e-mail addresses, IP addresses, card and phone numbers of a
text, each kind leftmost and non-overlapping, offsets in code points.

Terms are judged by information theory. A line of text is one observation. For
a protected kind k with lines p(k), the information content is IC = -ln p(k);
a term t discloses k as far as its pointwise mutual information
PMI = ln(p(t, k) / (p(t) p(k))) comes near to IC, which it reaches when every
line with t holds the kind. A term is generalised from ``GENERALISE`` x IC on and
removed from ``REMOVE`` x IC on, provided it stands beside ``SUPPORT`` different
values of the kind: words that merely accompany one person's address, however
often that text was copied, say nothing about the kind. All counts are taken
over all lines of all documents. A disclosing term is a span in every document
that holds an entity of its kind.

Everything is DataFrame code. Patterns are written with possessive quantifiers
and may start only where a run of their characters starts (or where the last
match ended), which gives the same matches in linear time and without recursion.

Null and empty texts have no spans; null texts stay null when sanitised. Rows
with equal doc_id and text are one document. A document table without any
entity has no disclosing terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import replaced_text, spans_text, staged

GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 5
KINDS = ("email", "ip", "card", "phone")
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EDGES = ".,;:!?()[]{}<>\"'|*#$%&"
SPAN = "struct<start:int,rank:int,kind:string,stop:int,value:string>"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            digits = F.regexp_replace(part, "^0+", "")
            return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _located(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """Spans of a pattern: the gaps between its matches and the matches, added up."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                        lambda gap, value: F.struct(F.char_length(gap).alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        end = begin + F.coalesce(F.char_length(piece["value"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        end.alias("stop"), piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(
            piece["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    return F.aggregate(pieces, start, add, lambda state: state["spans"])


def base_spans(text: Column) -> Column:
    """The valid matches of all kinds, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")
    found = [
        F.when(text.contains("@") if kind == "email" else text.rlike(HINTS[kind]), F.filter(
            _located(text, F.lit(PATTERNS[kind]), kind, rank), _check(kind))).otherwise(none)
        for rank, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*found))


def _terms(line: Column) -> Column:
    """The different words of a line, lower-case and without punctuation at the ends."""
    words = F.transform(F.split(F.lower(line), r"[\x20\x09-\x0D]+", -1), lambda w: F.btrim(w, F.lit(_EDGES)))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _plain(term: str = "term") -> Column:
    """Terms of letters and digits only: these can be put into a pattern as they are."""
    return F.col(term).rlike(r"^[\p{L}\p{N}]+$")


def entity_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, spans) of the documents that hold an entity, staged once."""
    found = docs.where(F.length("text") > 0).select(
        "doc_id", F.xxhash64("text").alias("key"), "text", base_spans(F.col("text")).alias("spans"))
    return staged(found.where(F.size("spans") > 0), "entities")


def disclosing_terms(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, term, action) of all terms whose mutual information with a kind is too high."""
    lines = F.explode(F.split("text", "\n", -1)).alias("line")
    held = entities.select(lines).withColumn("spans", base_spans(F.col("line"))).where(F.size("spans") > 0)
    # Entities must not count as their own terms.
    bare = F.col("line")
    for kind in KINDS:
        bare = F.regexp_replace(bare, PATTERNS[kind], " ")
    held = staged(held.select(
        F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"], s["value"]))).alias("values"),
        _terms(bare).alias("terms")), "entity-lines")
    kinds = F.array_distinct(F.transform("values", lambda v: v["kind"]))
    per_kind = held.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_k"))
    together = (
        held.select("terms", "values", F.explode(kinds).alias("kind"))
        .select("kind", F.filter("values", lambda v: v["kind"] == F.col("kind")).alias("values"),
                F.explode("terms").alias("term"))
        .where(_plain())
    )
    beside = together.select("kind", "term", F.explode("values.value").alias("value")).distinct()
    support = beside.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    both = together.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n_tk"))
    candidates = staged(both.join(support, ["kind", "term"]), "entity-terms")
    all_lines = docs.select(lines).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    n_lines = all_lines.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_terms = all_lines.select(F.explode(_terms(F.col("line"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_t"))
    total = n_lines.cast("double")
    content = F.log(total / F.col("n_k"))
    shared = F.log(F.col("n_tk") * total / (F.col("n_t") * F.col("n_k")))
    judged = n_terms.join(candidates, "term").join(F.broadcast(per_kind), "kind")  # four kinds at most
    return judged.where(content > 0).withColumn("share", shared / content).where(
        F.col("share") >= GENERALISE).select(
        "kind", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def term_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, extra): the spans of disclosing terms, for each document that has some."""
    entities = entity_documents(docs)
    words = entities.select(
        "doc_id", "key", F.array_distinct("spans.kind").alias("kinds"),
        F.explode(_terms(F.col("text"))).alias("term")).where(_plain())
    found = words.select("doc_id", "key", "term", F.explode("kinds").alias("kind")).join(
        disclosing_terms(docs, entities), ["kind", "term"])
    of_doc = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
    joined = entities.dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias("id"), F.col("key").alias("k"), "text")
    joined = of_doc.join(joined, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))

    def located(t: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), t["term"], F.lit(r"(?![\p{L}\p{N}])"))
        spans = _located(F.col("text"), pattern, "term", len(KINDS))
        return F.transform(spans, lambda s: s.withField("value", t["action"]))

    return joined.select("doc_id", "key", F.array_sort(F.flatten(F.transform("terms", located))).alias("extra"))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with __base and __extra, the sorted spans of both sorts."""
    extra = term_spans(docs).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("extra").alias("__extra"))
    own = docs.withColumn("__base", base_spans(F.coalesce("text", F.lit("")))).withColumn(
        "__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(extra, own["doc_id"].eqNullSafe(extra["__id"]) & (own["__own"] == extra["__key"]), "left")


def privacy_query(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, per document."""
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    narrow = narrow.select("doc_id", base_spans(F.col("text")).alias("base"), F.xxhash64("text").alias("own"))
    extra = term_spans(docs).withColumnRenamed("doc_id", "id")
    joined = narrow.join(
        extra, narrow["doc_id"].eqNullSafe(extra["id"]) & (narrow["own"] == extra["key"]), "left")
    everything = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    return joined.select(
        "doc_id",
        *[F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(everything).alias("spans"))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first one names the gap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        label = F.when(s["value"] == "remove", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        label = F.when(s["kind"] == "term", label).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        longer = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), label)
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= state["at"], longer).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda state: F.concat(
        state["out"], F.substring(text, state["at"] + 1, F.lit(2**31 - 1))))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with entities masked and disclosing terms generalised or removed."""
    found = with_spans(docs).withColumn("__all", F.array_sort(F.concat(
        "__base", F.coalesce("__extra", F.array().cast(f"array<{SPAN}>")))))
    return replaced_text(found, F.when(F.size("__all") == 0, F.col("text")).otherwise(
        _sanitised(F.col("text"), F.col("__all")))).select(*docs.columns)
