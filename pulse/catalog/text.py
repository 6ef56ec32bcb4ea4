"""Keyword, topic, length, term, TF-IDF and sentiment jobs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import (
    COMMENTS,
    POSTS,
    Tables,
    post_time,
    query,
    quoted,
    sql_clean,
    sql_tokens,
)
from pulse.catalog.market import FILLED, POST_DAYS, recent_series
from pulse.functions import text as words
from pulse.functions.keywords import keyword_columns, overlaps_any
from pulse.functions.values import DELETED, REMOVED
from pulse.operators import learning, quantiles, terms
from pulse.operators.cleaning import computed_once
from pulse.operators.sentiment import sentiment_from_table
from pulse.plans import market, text
from pulse.sources.readers import local_lookup
from pulse.sources.schema import TEXT, struct_of
from pulse.sources.sinks import stage

TOPIC = ("license", "worthless", "idiot", "trash")
STEMS = {"labor": ("licens", "job", "labor"), "yolo": ("worthless", "all in"), "btd": ("idiot", "moron")}
POSITIVE = ("rely", "rest", "tion", "good")
NEGATIVE = ("worthless", "idiot", "trash", "moron", "clown", "pathetic")
LEMMAS = (("ands", "and"), ("idiots", "idiot"), ("worthless", "worth"), ("rely", "re"), ("esly", "es"))
YEAR = "CAST(year(t) AS INTEGER) AS year"


def _year():
    return F.year(post_time())


def _keywords():
    return keyword_columns(F.col("body"), STEMS)


def _stems_sql(name: str) -> str:
    return f"regexp_matches(body, '(?i)\\b(?:{'|'.join(STEMS[name])})')"


FLAGS = {
    "dollar": "regexp_matches(body, '\\$')", "ellipsis": "regexp_matches(body, '\\.{3}')",
    **{name: _stems_sql(name) for name in STEMS},
}
RATES = ", ".join(f"AVG(CAST({rule} AS INTEGER)) AS {name}" for name, rule in FLAGS.items())
ON_TOPIC = f"regexp_matches(body, '(?i){'|'.join(TOPIC)}')"
CLEAN = f"{POSTS}, clean AS (SELECT *, {sql_clean('body')} AS w FROM posts)"
LEMMA_CLEAN = f"{POSTS}, clean AS (SELECT *, {sql_clean('body', lemmas=LEMMAS)} AS w FROM posts)"
LEMMA_LONG = f"{LEMMA_CLEAN}, rows AS (SELECT id, year(t) AS year, unnest(w) AS term FROM clean)"
LONG = f"{CLEAN}, rows AS (SELECT id, year(t) AS year, unnest(w) AS term FROM clean)"
SCORE = (
    f"len(list_filter(w, lambda x: x IN ({quoted(POSITIVE)}))) - "
    f"len(list_filter(w, lambda x: x IN ({quoted(NEGATIVE)})))"
)
SENTIMENT = f"""{CLEAN}, classified AS (SELECT *, CAST(len(w) AS INTEGER) AS length_of_body,
  CASE WHEN len(w) = 0 THEN '' WHEN {SCORE} > 0 THEN 'positive' WHEN {SCORE} < 0 THEN 'negative'
       ELSE 'neutral' END AS sentiment_class FROM clean)"""


@query("C11 T15 X15 A3", f"""WITH {POSTS} SELECT {YEAR}, {ON_TOPIC} AS on_topic, COUNT(*) AS n
FROM posts GROUP BY ALL""")
def topic_share(t: Tables) -> DataFrame:
    return text.topic_share(t.posts, "body", _year(), TOPIC)


@query("C12 T2 T3 T13 X25 W4", f"""WITH {CLEAN}, rows AS (
  SELECT {YEAR}, unnest(w) AS term FROM clean WHERE {ON_TOPIC}),
counts AS (SELECT year, term, COUNT(*) AS n FROM rows WHERE term NOT IN ({quoted(TOPIC)}) GROUP BY ALL)
SELECT year, term, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, term) AS rank FROM counts)
WHERE rank <= 100""")
def topic_hot_words(t: Tables) -> DataFrame:
    return text.topic_hot_words(t.posts, "body", _year(), TOPIC, 100)


@query("X13 X14 T16", f"""WITH {POSTS} SELECT id, {', '.join(f'{r} AS {n}' for n, r in FLAGS.items())}
FROM posts""")
def keyword_flags(t: Tables) -> DataFrame:
    return t.posts.withColumns(_keywords()).select("id", *FLAGS)


@query("C20 T16 A7", f"WITH {POSTS} SELECT {YEAR}, {RATES} FROM posts GROUP BY 1")
def keyword_rates(t: Tables) -> DataFrame:
    return text.keyword_rates(t.posts, "body", _year(), _keywords())


@query("C20 A8", f"WITH {POSTS} SELECT {RATES.replace(' AS btd', ' AS btd_mean')} FROM posts".replace(
    f"AVG(CAST({FLAGS['btd']} AS INTEGER)) AS btd_mean",
    f"CAST(SUM(CAST({FLAGS['btd']} AS INTEGER)) AS BIGINT) AS btd_sum"))
def keyword_rates_overall(t: Tables) -> DataFrame:
    return text.keyword_rates(t.posts, "body", None, _keywords(), totals=["btd"])


@query("C22 A10 P9", f"""WITH {POSTS}, b AS (
  SELECT quantile_cont(score, 0.95) AS lo, quantile_cont(score, 0.99) AS hi FROM posts)
SELECT id, score FROM posts, b WHERE score >= lo AND score <= hi""")
def score_band(t: Tables) -> DataFrame:
    return text.score_band(t.posts, "score", 0.95, 0.99).select("id", "score")


_Q = ", ".join(f"round(quantile_cont({{0}}, {p}), 6) AS {name}" for name, p in (
    ("q1", 0.01), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q99", 0.99)))


def _report_sql(measure: str) -> str:
    return f"""SELECT '{measure}' AS feature_name, year, CAST(MIN({measure}) AS DOUBLE) AS min,
      {_Q.format(measure)}, round(AVG({measure}), 2) AS mean, CAST(MAX({measure}) AS DOUBLE) AS max,
      NULL AS percentage FROM measured GROUP BY year"""


@query("C23 T8 A11 A12 U2 X18", f"""WITH {COMMENTS}, measured AS (
  SELECT {YEAR}, len({sql_clean('body')}) AS n_words, score, controversiality FROM comments)
SELECT feature_name, year, min, q1, q25, median, mean, q75, q99, max, percentage FROM (
{_report_sql('n_words')} UNION ALL BY NAME {_report_sql('score')} UNION ALL BY NAME
SELECT 'controversiality' AS feature_name, year, NULL AS min, NULL AS q1, NULL AS q25, NULL AS median,
  NULL AS q75, NULL AS q99, NULL AS mean, NULL AS max, AVG(controversiality) AS percentage
FROM measured GROUP BY year)""")
def quantile_report(t: Tables) -> DataFrame:
    measured = t.comments.select(
        _year().alias("year"), F.size(words.clean_tokens(F.col("body"))).alias("n_words"), "score",
        "controversiality",
    )
    report = text.feature_report(measured, ["n_words", "score"], ["controversiality"])
    # six places: the last bit of an interpolation depends on the engine
    return report.withColumns({q: F.round(q, 6) for q in quantiles.REPORT_PROBS})


@query("C24 T8 A17 O1", f"""WITH {CLEAN} SELECT CAST(len(w) AS INTEGER) AS length, COUNT(*) AS n
FROM clean GROUP BY 1""")
def length_histogram(t: Tables) -> DataFrame:
    return quantiles.length_histogram(
        t.posts, F.size(words.clean_tokens(F.col("body")))
    ).orderBy("length")


@query("C25 T4 T9 T13 O3 A16 F2", f"""WITH {LEMMA_LONG}, counts AS (
  SELECT CAST(year AS INTEGER) AS year, term, COUNT(*) AS n FROM rows GROUP BY ALL)
SELECT year, term, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, term) AS rank FROM counts)
WHERE rank <= 300""")
def top_words(t: Tables) -> DataFrame:
    return text.top_words(t.posts, "body", _year(), 300, lemmas=dict(LEMMAS))


@query("A16 T13", f"""WITH {LONG} SELECT CAST(year AS INTEGER) AS year, term, COUNT(*) AS n FROM rows
GROUP BY ALL""")
def term_totals_by_year(t: Tables) -> DataFrame:
    rows = t.posts.select(_year().alias("year"), "body")
    return terms.corpus_terms(rows, words.clean_tokens(F.col("body")), ["year"])


@query("A16 T13", f"WITH {LONG} SELECT term, COUNT(*) AS n FROM rows GROUP BY 1")
def term_totals(t: Tables) -> DataFrame:
    return terms.corpus_terms(t.posts, words.clean_tokens(F.col("body")))


KEYED = """tf AS (SELECT {by}, id, term, COUNT(*) AS tf FROM rows GROUP BY ALL),
df AS (SELECT {by}, term, COUNT(*) AS df FROM tf GROUP BY ALL),
weighted AS (SELECT tf.{by}, tf.id, tf.term, tf, df, tf * ln((n + 1) / (df + 1)) AS w
  FROM tf JOIN df ON tf.{by} = df.{by} AND tf.term = df.term JOIN sizes ON sizes.{by} = tf.{by}),
best AS (SELECT *, row_number() OVER (PARTITION BY {by}, id ORDER BY w DESC, df DESC, term) AS r
  FROM weighted),
keys AS (SELECT {by}, term, COUNT(*) AS n_docs FROM best WHERE r = 1 AND w > 0 GROUP BY ALL)"""


@query("C26 T4 T10 T11 T14 W6 F1", f"""WITH {LEMMA_CLEAN},
rows AS (SELECT CAST(year(t) AS INTEGER) AS period, id, unnest(w) AS term FROM clean),
sizes AS (SELECT CAST(year(t) AS INTEGER) AS period, COUNT(*) AS n FROM posts GROUP BY 1),
{KEYED.format(by='period')}
SELECT period, term, n_docs FROM keys""")
def key_terms(t: Tables) -> DataFrame:
    return text.key_words(t.posts, "id", "body", _year(), lemmas=dict(LEMMAS))


@query("C33 T9 T14", f"""WITH {COMMENTS}, bad AS (
  SELECT id, TRUE AS period, {sql_clean('body')} AS w FROM comments
  WHERE author = '{DELETED}' AND body NOT IN ('{DELETED}', '{REMOVED}')),
rows AS (SELECT period, id, unnest(w) AS term FROM bad),
sizes AS (SELECT period, COUNT(*) AS n FROM bad GROUP BY 1),
{KEYED.format(by='period')}
SELECT term, n_docs, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY n_docs DESC, term) AS rank FROM keys) WHERE rank <= 30""")
def class_key_terms(t: Tables) -> DataFrame:
    gone = t.comments.filter(
        (F.col("author") == DELETED) & ~F.col("body").isin(DELETED, REMOVED)
    )
    return text.key_words(gone, "id", "body", F.lit(True), 30).drop("period")


@query("T10", f"WITH {LONG} SELECT id, term, COUNT(*) AS tf FROM rows GROUP BY ALL")
def term_counts(t: Tables) -> DataFrame:
    return terms.term_counts(t.posts, "id", words.clean_tokens(F.col("body")))


@query("T11", f"""WITH {LONG}, df AS (SELECT term, COUNT(DISTINCT id) AS df FROM rows GROUP BY 1)
SELECT term, df, round(ln(((SELECT COUNT(*) FROM posts) + 1) / (df + 1)), 6) AS idf
FROM df""")
def term_idf(t: Tables) -> DataFrame:
    tokens = words.clean_tokens(F.col("body"))
    counts = terms.term_counts(t.posts, "id", tokens)
    return terms.inverse_frequency(counts, t.posts).select(
        "term", "df", F.round("idf", 6).alias("idf")
    )


@query("T10 T11 J6 F1", f"""WITH {LONG},
tf AS (SELECT id, term, COUNT(*) AS tf FROM rows GROUP BY ALL),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1)
SELECT id, term AS word, CAST(tf AS DOUBLE) AS tf,
  round(tf * ln(((SELECT COUNT(*) FROM posts) + 1) / (df + 1)), 6) AS weight FROM tf JOIN df USING (term)""")
def vectorised_terms(t: Tables) -> DataFrame:
    """The same weights over a numbered vocabulary: one join brings the index and the weight of each term.

    The vocabulary is a table that Spark numbers; it never passes the driver and has no bound.
    """
    counts = terms.staged_counts(t.posts, "id", words.clean_tokens(F.col("body")))
    vocabulary = stage(terms.vocabulary(terms.inverse_frequency(counts, t.posts)), t.scratch("vocabulary"))
    cells = terms.encode_terms(counts, vocabulary, "index", keep=["idf"])
    return cells.select(
        "id", F.col("term").alias("word"), F.col("tf").cast("double").alias("tf"),
        F.round(F.col("tf") * F.col("idf"), 6).alias("weight"),
    )


@query("T1", f"""WITH {POSTS} SELECT id, CAST(len(list_filter(
  string_split_regex(body, '[.!?]+\\s+'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n_sentences
FROM posts""")
def sentence_counts(t: Tables) -> DataFrame:
    return t.posts.select("id", F.size(words.sentences(F.col("body"))).alias("n_sentences"))


@query("T2 T3 T4 T5 T6 T9", f"""WITH {LEMMA_CLEAN} SELECT id, CAST(len({sql_tokens('body')}) AS INTEGER) AS n_raw,
CAST(len(w) AS INTEGER) AS n_clean, md5(array_to_string(w, ' ')) AS clean_digest FROM clean""")
def clean_text(t: Tables) -> DataFrame:
    body = F.col("body")
    raw = t.posts.select("id", "body", F.size(words.tokens(body)).alias("n_raw"))
    return computed_once(raw, "w", words.clean_tokens(body, lemmas=dict(LEMMAS))).select(
        "id", "n_raw", F.size("w").alias("n_clean"),
        F.md5(words.joined(F.col("w"))).alias("clean_digest"),
    )


_LEMMA_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in LEMMAS)


@query("T4", f"""WITH {LONG} SELECT COALESCE(lemma, term) AS term, COUNT(*) AS n FROM rows
LEFT JOIN (VALUES {_LEMMA_ROWS}) AS k(token, lemma) ON rows.term = k.token GROUP BY 1""")
def lemma_totals(t: Tables) -> DataFrame:
    """Terms are counted before the dictionary join, so the join sees each term once."""
    lemmas = local_lookup(t.spark, LEMMAS, struct_of(token=TEXT, lemma=TEXT))
    totals = terms.corpus_terms(t.posts, words.clean_tokens(F.col("body")))
    return terms.lemmatise_rows(totals, lemmas).groupBy("term").agg(F.sum("n").alias("n"))


@query("T4 T6", f"""WITH {CLEAN} SELECT id, md5(array_to_string(list_transform(w, lambda x: CASE
  {' '.join(f"WHEN x = '{a}' THEN '{b}'" for a, b in LEMMAS)} ELSE x END), ' ')) AS digest FROM clean""")
def lemmatised_text(t: Tables) -> DataFrame:
    """The dictionary as a table of any size: texts are read once, and their tokens staged."""
    lemmas = local_lookup(t.spark, LEMMAS, struct_of(token=TEXT, lemma=TEXT))
    rows = t.posts.select("id", words.clean_tokens(F.col("body")).alias("w"))
    return terms.lemmatise(rows, "id", "w", lemmas).select(
        "id", F.md5(words.joined(F.col("w"))).alias("digest")
    )


@query("T7 X21")
def document_vectors(t: Tables) -> DataFrame:
    rows = t.posts.select("id", words.clean_tokens(F.col("body")).alias("tokens"))
    vectors = learning.fit_vectors(rows, "tokens", size=16).transform(rows)
    return vectors.select("id", vector_to_array("vector").alias("vector"))


@query("T7 A21", """SELECT label, CAST(dim AS INTEGER) AS dim, round(AVG(CAST(x AS DOUBLE)), 6) AS mean FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings)
GROUP BY ALL""")
def mean_vectors(t: Tables) -> DataFrame:
    return terms.mean_vectors(t.embeddings, "embedding", "label").withColumn("mean", F.round("mean", 6))


@query("T12")
def hashed_terms(t: Tables) -> DataFrame:
    rows = t.posts.select("id", words.joined(words.clean_tokens(F.col("body"))).alias("clean_text"))
    stages = learning.text_stages("clean_text")
    return Pipeline(stages=stages).fit(rows).transform(rows).select(
        "id", _mass("features").alias("mass")
    )


def _mass(vector: str) -> Column:
    """Sum of the stored cells of a vector."""
    return F.aggregate(F.unwrap_udt(vector)["values"], F.lit(0.0), lambda a, x: a + x)


@query("T12", f"WITH {CLEAN} SELECT id, CAST(len(w) AS DOUBLE) AS n_terms FROM clean")
def hashed_counts(t: Tables) -> DataFrame:
    """Hashed term counts add up to the number of words, whatever collides."""
    rows = t.posts.select("id", words.joined(words.clean_tokens(F.col("body"))).alias("clean_text"))
    stages = learning.text_stages("clean_text")[:-1]
    return Pipeline(stages=stages).fit(rows).transform(rows).select("id", _mass("hashed").alias("n_terms"))


@query("C27 T17 A18", f"""WITH {SENTIMENT} SELECT {YEAR}, sentiment_class,
AVG(length_of_body) AS average_length_of_body, AVG(score) AS average_score,
AVG(CAST({FLAGS['dollar']} AS INTEGER)) AS dollar_percentage,
AVG(CAST({FLAGS['labor']} AS INTEGER)) AS labor_percentage,
AVG(CAST({FLAGS['yolo']} AS INTEGER)) AS yolo_percentage FROM classified GROUP BY ALL""")
def sentiment_summary(t: Tables) -> DataFrame:
    flags = _keywords()
    return text.sentiment_summary(
        text.with_sentiment(t.posts, "body", POSITIVE, NEGATIVE), _year(),
        {"average_length_of_body": F.col("length_of_body"), "average_score": F.col("score")},
        {f"{name}_percentage": flags[name] for name in ("dollar", "labor", "yolo")},
    )


@query("C28 T17 A19 J1", f"""WITH {SENTIMENT}, {FILLED}, {POST_DAYS}, daily AS (
  SELECT CAST(t AS DATE) AS date, sentiment_class, COUNT(*) AS comment_count,
    AVG(length_of_body) AS avg_len, AVG(score) AS avg_score
  FROM classified WHERE sentiment_class <> '' GROUP BY ALL)
SELECT daily.date AS "Date", sentiment_class AS "Sentiment", comment_count, avg_len, avg_score, index_f
FROM daily LEFT JOIN moved ON moved.date = daily.date""")
def sentiment_daily(t: Tables) -> DataFrame:
    daily = market.sentiment_daily(
        text.with_sentiment(t.posts, "body", POSITIVE, NEGATIVE), post_time(), "sentiment_class",
        {"avg_len": F.col("length_of_body"), "avg_score": F.col("score")}, recent_series(t),
    )
    return market.present(
        daily, {"date": "Date", "sentiment_class": "Sentiment"},
        ["date", "sentiment_class", "comment_count", "avg_len", "avg_score", "index_f"],
    )


_LEXICON = [(w, 1) for w in POSITIVE] + [(w, -1) for w in NEGATIVE]


@query("T17", f"WITH {SENTIMENT} SELECT id, sentiment_class FROM classified")
def sentiment_by_table(t: Tables) -> DataFrame:
    lexicon = local_lookup(t.spark, _LEXICON, "term string, weight int")
    rows = t.posts.select("id", words.clean_tokens(F.col("body")).alias("w"))
    return sentiment_from_table(rows, "id", "w", lexicon).select("id", "sentiment_class")


@query("T18 X19", f"""WITH {CLEAN} SELECT id, list_has_any(w, [{quoted(NEGATIVE)}]) AS contains_frequent
FROM clean""")
def frequent_word_flag(t: Tables) -> DataFrame:
    clean = words.clean_tokens(F.col("body"))
    return t.posts.select("id", overlaps_any(clean, NEGATIVE).alias("contains_frequent"))
