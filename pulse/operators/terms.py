"""Term tables: counts, document frequency, TF-IDF and key words, in long form.

A (document, term) row needs no vocabulary index, so every term of the corpus
takes part and no index can be decoded with the wrong vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.activity import top_n_within
from pulse.operators.joins import null_safe_join, salted_join
from pulse.operators.ranking import numbered
from pulse.session import scratch_path
from pulse.sources.sinks import stage

HOT_TERMS = 100_000


def token_rows(df: DataFrame, tokens: Column, keep: Sequence[str]) -> DataFrame:
    """One row per token.

    The outer form keeps the optimiser from adding a filter on the array size,
    which would run the whole token expression a second time.
    """
    return df.select(*keep, F.explode_outer(tokens).alias("term")).filter(
        F.col("term").isNotNull()
    )


def lemmatise_rows(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace each term by its lemma; ``lemmas`` has the columns token and lemma."""
    table = lemmas.select(F.col("token").alias("term"), "lemma")
    return rows.join(table, ["term"], "left").withColumn(
        "term", F.coalesce("lemma", "term")
    ).drop("lemma")


def looked_up(df: DataFrame, doc: str, tokens: str, table: DataFrame, name: str) -> DataFrame:
    """Rows with a map from those of their tokens that ``table`` (term, value) holds to the values.

    The rows are staged with their tokens, so what made the tokens runs once. Each
    different token of a text meets the table once, and only hits are brought back.
    """
    kept = stage(df, scratch_path(df.sparkSession, "tokens"))
    hits = kept.select(doc, F.explode(F.array_distinct(tokens)).alias("term")).join(table, ["term"])
    maps = hits.groupBy(doc).agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias(name))
    return null_safe_join(kept, maps, [doc], "left")


def lemmatise(df: DataFrame, doc: str, tokens: str, lemmas: DataFrame) -> DataFrame:
    """Replace the tokens of an array by their lemmas, order kept, for dictionaries of any size.

    A short dictionary needs no join: pass it to :func:`pulse.functions.text.clean_tokens`.
    """
    table = lemmas.select(F.col("token").alias("term"), F.col("lemma").alias("value"))
    found = looked_up(df, doc, tokens, table, "lemma_of")
    return found.withColumn(tokens, F.transform(
        tokens, lambda t: F.coalesce(F.try_element_at("lemma_of", t), t))).drop("lemma_of")


def corpus_terms(df: DataFrame, tokens: Column, by: Sequence[str] = (),
                 exclude: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each term per period."""
    rows = token_rows(df, tokens, by)
    if exclude:
        rows = rows.filter(~F.col("term").isin(*exclude))
    return rows.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(terms: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The n most frequent terms of each period; equal counts are ordered by term."""
    return top_n_within(terms, by, "term", n)


def term_counts(df: DataFrame, doc: str, tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each term in each document.

    The tokens of a document sit in one task, so the partial aggregate already
    reduces them before the shuffle.
    """
    return token_rows(df, tokens, [*by, doc]).groupBy(*by, doc, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def staged_counts(df: DataFrame, doc: str, tokens: Column, by: Sequence[str] = ()) -> DataFrame:
    """:func:`term_counts` as a stage, for weights: these use the counts several times and texts are cleaned once."""
    return stage(term_counts(df, doc, tokens, by), scratch_path(df.sparkSession, "counts"))


def inverse_frequency(counts: DataFrame, docs: DataFrame, by: Sequence[str] = (),
                      min_docs: int = 1) -> DataFrame:
    """df and ln((N + 1) / (df + 1)) per term, N being all documents of the period."""
    by = list(by)
    # counting over tf keeps it in this plan, which then shares the shuffle of counts
    # that are no stage with other uses instead of reading the texts again
    frequency = counts.groupBy(*by, "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    if min_docs > 1:
        frequency = frequency.filter(F.col("df") >= min_docs)
    sizes = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    if by:
        sized = salted_join(frequency, sizes, by, ["term"], null_safe=True)
    else:
        sized = frequency.withColumn("n_docs", sizes.scalar())
    return sized.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)))


def tf_idf(df: DataFrame, doc: str, tokens: Column, by: Sequence[str] = (),
           min_docs: int = 1) -> DataFrame:
    """TF-IDF of each (document, term).

    A common term is a hot join key held by most documents, so it is kept out of
    the shuffle join. A term is hot when it holds at least one part in HOT_TERMS
    of all rows: there can be no more than HOT_TERMS such terms whatever the
    data, so they are broadcast, and every other term is at most that one part
    of the shuffle.
    """
    keys = [*by, "term"]
    counts = staged_counts(df, doc, tokens, by)
    idf = stage(inverse_frequency(counts, df, by, min_docs), scratch_path(df.sparkSession, "idf"))
    all_rows = idf.agg(F.sum("df")).scalar()
    split = idf.drop("n_docs").withColumn("is_hot", F.col("df") * HOT_TERMS >= all_rows)
    hot = F.broadcast(split.filter("is_hot").drop("is_hot"))
    rare = split.filter(~F.col("is_hot")).drop("is_hot")
    join = null_safe_join if by else _plain_join
    # one outer join for both branches: a semi or anti join would sink below the
    # counts and make each branch count on its own
    marked = join(counts, hot, keys, "left")
    weighted = marked.filter(F.col("df").isNotNull()).unionByName(
        join(marked.filter(F.col("df").isNull()).drop("df", "idf"), rare, keys)
    )
    return weighted.withColumn("tf_idf", F.col("tf") * F.col("idf"))


def _plain_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def best_terms(weights: DataFrame, doc: str, by: Sequence[str] = ()) -> DataFrame:
    """The key word of each document: highest TF-IDF, then document frequency, then term.

    Documents without terms, or whose best weight is 0, have none. A document
    belongs to one period, which therefore rides along and is no grouping key.
    """
    order = F.struct(
        (-F.col("tf_idf")).alias("weight"), (-F.col("df")).alias("df"), "term", *by
    )
    return weights.groupBy(doc).agg(F.min(order).alias("best")).filter(
        F.col("best.weight") < 0
    ).select(*[F.col("best")[c].alias(c) for c in by], doc, F.col("best.term").alias("term"))


def key_terms(df: DataFrame, doc: str, tokens: Column, by: Sequence[str] = (),
              min_docs: int = 1) -> DataFrame:
    """How many documents of each period have a term as their key word."""
    best = best_terms(tf_idf(df, doc, tokens, by, min_docs), doc, by)
    return best.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(frequency: DataFrame, index: str = "index", word: str = "word") -> DataFrame:
    """Every term with a number by falling document frequency, ties by term."""
    return numbered(frequency, [F.desc("df"), F.asc("term")], index).withColumnRenamed("term", word)


def encode_terms(rows: DataFrame, table: DataFrame, index: str = "index", word: str = "word",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Vocabulary indices for the column term, and what else of the table is to be kept, by one join."""
    return rows.join(table.select(F.col(word).alias("term"), index, *keep), ["term"])


def decode_index(df: DataFrame, index: str, table: DataFrame) -> DataFrame:
    """Words, and whatever else the vocabulary table holds, for its indices, by join."""
    return df.join(table, [index], "left")


def mean_vectors(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Element-wise mean per label, one row per label and dimension."""
    return df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(
        F.avg("x").alias("mean")
    )
