"""Quality rules: a learned decision list over text statistics.

Statistics of a text are computed in its own row, with built-in functions only.
Rules come from labelled statistics by sequential covering: a rule is a
conjunction of thresholds, grown one threshold at a time by information gain on
two thirds of the rows, then pruned from its end on the others as long as its
precision there does not fall; rows it covers leave, and the next rule is grown
on the rest. Rules condemn a text ("low quality"), in the order found, and what
no rule covers is kept. The list becomes one ordered conditional expression.

A bounded number of labelled rows (``SAMPLE``, chosen by a hash of the id) is
used for learning. Spark counts them for each statistic, cut point and
label; only these counts, at most statistics x ``CUTS`` rows a step, reach the
driver.

Null and empty texts have no words and fail the base rule. Without labels, or
with one class only, the list is empty and the base rule alone decides. Rows
with equal doc_id are judged alike if their texts are equal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import WORD, staged

SAMPLE = 50_000
CUTS = 16
MOST_RULES, MOST_TERMS = 8, 3
#: Least number of rows that a rule covers, and its least precision on rows it was not grown on.
LEAST_ROWS, LEAST_PRECISION = 8, 0.9

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "bar_share", "stop_share", "words_per_line", "unique_share",
)


def _repeated_words(hashes: str) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    ``hashes`` holds the hash of each window. Windows are sorted with their place;
    equal neighbours are repeats; their places, sorted again, cover up to three
    words each.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(
            F.transform(s, lambda e, k: F.struct(
                e["i"].alias("i"),
                (F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                 | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))).alias("again"))),
            lambda e: e["again"]), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda n, x: n + x)

    # A one-element array lends the sorted windows, and then the places, a name of their own.
    inner = F.get(F.transform(F.array(ordered), lambda s: F.get(F.transform(F.array(places(s)), covered), 0)), 0)
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeats, inner).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts and the shares that rules are made of."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    first = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", words.alias("words"), lines.alias("lines"))
    second = first.select(
        "doc_id", "text", "words", "lines",
        F.when(F.size("words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))

    def share(pattern: str) -> Column:
        return F.char_length(F.regexp_replace("text", pattern, "")).cast("long")

    chars = F.char_length("text").cast("long")
    counted = second.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (chars - share(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("windows").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_different"),
        (chars - share(r"\p{Lu}")).alias("n_upper"), (chars - share(r"[0-9]")).alias("n_digits"),
        (chars - share(r"[!?]")).alias("n_marks"), (chars - share(r"[|]")).alias("n_bars"),
        F.size(F.filter("words", lambda w: F.char_length(w) <= 3)).cast("long").alias("n_short"))

    def ratio(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1))

    return counted.select(
        "doc_id", *BASE,
        ratio("word_chars", "n_words").alias("mean_word"), ratio("n_symbols", "word_chars").alias("symbol_share"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_share"),
        ratio("n_repeat_words", "n_words").alias("repeat_share"),
        ratio("n_upper", "word_chars").alias("upper_share"), ratio("n_digits", "word_chars").alias("digit_share"),
        ratio("n_marks", "word_chars").alias("mark_share"), ratio("n_bars", "word_chars").alias("bar_share"),
        ratio("n_short", "n_words").alias("stop_share"), ratio("n_words", "n_lines").alias("words_per_line"),
        ratio("n_different", "n_words").alias("unique_share"))


@dataclass(frozen=True)
class Term:
    """``name <= cut`` or ``name > cut``."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:g}"


Rule = tuple[Term, ...]


def _holds(rule: Rule) -> Column:
    held = F.lit(True)
    for term in rule:
        held = held & term.column()
    return held


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that holds, or null."""
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(_holds(rule), i).otherwise(number)
    return number


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_sample(stats: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Statistics and label (1: low quality) of at most ``bound`` labelled rows that pass the base rule."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("low"))
        .orderBy(key, "doc_id").limit(bound)
    )
    # At most `bound` rows of two numbers.
    return stats.join(F.broadcast(chosen), "doc_id").where(~base_failed()).select(
        "low", *STATISTICS, (F.pmod(F.xxhash64(F.lit("grow"), key), F.lit(3)) > 0).alias("grow"))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> list:
    """Rows above each cut point: (name, k, low, n); k counts the cut points below the value."""
    bins = [F.struct(F.lit(name).alias("name"), sum(
        ((F.col(name) > c).cast("int") for c in cuts[name]), F.lit(0)).alias("k")) for name in cuts]
    return rows.select("low", F.explode(F.array(*bins)).alias("b")).groupBy("b.name", "b.k").agg(
        F.sum("low").alias("low"), F.count(F.lit(1)).alias("n")).collect()


def _gain(low: int, n: int, low_before: int, n_before: int) -> float:
    """FOIL's gain: rows kept of the wanted class, times the information won on each."""
    if not low:
        return 0.0
    return low * (math.log2(low / n) - math.log2(low_before / n_before))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_TERMS:
        found = _counts(rows.where(_holds(rule)), cuts)
        total = [r for r in found if r["name"] == STATISTICS[0]]
        low_all, n_all = sum(r["low"] for r in total), sum(r["n"] for r in total)
        if not low_all or low_all == n_all:
            break
        best, chosen = 0.0, None
        for name, edges in cuts.items():
            of_name = [r for r in found if r["name"] == name]
            for k, cut in enumerate(edges):
                above = [r for r in of_name if r["k"] > k]
                low, n = sum(r["low"] for r in above), sum(r["n"] for r in above)
                for side, a, b in ((True, low, n), (False, low_all - low, n_all - n)):
                    gain = _gain(a, b, low_all, n_all) if b >= LEAST_ROWS and b < n_all else 0.0
                    if gain > best + 1e-9:
                        best, chosen = gain, Term(name, side, cut)
        if chosen is None:
            break
        rule += (chosen,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float, int]:
    """The prefix of a rule with the best precision on other rows (the shorter of equal ones), and its figures."""
    parts = [rule[:i] for i in range(1, len(rule) + 1)]
    one = rows.agg(*[f for i, part in enumerate(parts) for f in (
        F.coalesce(F.sum(F.when(_holds(part), F.col("low"))), F.lit(0)).alias(f"low{i}"),
        F.count_if(_holds(part)).alias(f"n{i}"))]).first()
    figures = [(one[f"low{i}"], one[f"n{i}"]) for i in range(len(parts))]
    best = max(range(len(parts)), key=lambda i: ((figures[i][0] + 1) / (figures[i][1] + 2), -i))
    return parts[best], figures[best][0] / max(figures[best][1], 1), figures[best][1]


def learn(sample: DataFrame) -> list[Rule]:
    """Sequential covering on labelled statistics."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    # Cut points lie midway between neighbouring quantiles of either class: rare junk has its own, and room on both sides.
    ends = {r["low"]: r for r in sample.groupBy("low").agg(*[
        F.percentile_approx(c, shares, 10_000).alias(c) for c in STATISTICS]).collect()}
    if len(ends) < 2:
        return []
    values = {c: sorted({float(v) for r in ends.values() for v in r[c]}) for c in STATISTICS}
    cuts = {c: [(a + b) / 2 for a, b in pairwise(v)] for c, v in values.items()}
    rules: list[Rule] = []
    rest = sample
    while len(rules) < MOST_RULES:
        rule = _grow(rest.where("grow"), cuts)
        if not rule:
            break
        rule, precision, n = _prune(rest.where(~F.col("grow")), rule)
        if precision < LEAST_PRECISION or n < LEAST_ROWS // 2:
            break
        rules.append(rule)
        rest = rest.where(~_holds(rule))
    return rules


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rule that condemned a text."""
    stats = staged(statistics(docs), "quality-statistics")
    rules = learn(staged(labelled_sample(stats, labels), "quality-sample"))
    judged = stats.withColumn("number", verdict(rules))
    texts = F.array(*[F.lit(" and ".join(map(str, rule))) for rule in rules]).cast("array<string>")
    return judged.select(
        "doc_id", *BASE, base_failed().alias("base_failed"),
        (~base_failed() & F.col("number").isNull()).alias("kept"),
        F.get(texts, F.col("number")).alias("rule"))
