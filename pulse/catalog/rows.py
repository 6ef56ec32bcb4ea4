"""Projections, filters, unions and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import COMMENTS, POSTS, Tables, post_time, query, sql_tokens
from pulse.functions.text import joined, tokens
from pulse.functions.timefx import in_year, parse_day, time_text
from pulse.functions.values import (
    UNKNOWN,
    blank_to_unknown,
    flag_int,
    has_award,
    is_edited,
    is_missing,
)
from pulse.operators import cleaning
from pulse.operators.activity import count_by
from pulse.operators.sampling import stack
from pulse.plans import profile


@query("C3 P2 X3 X7 X9", f"""WITH {COMMENTS}
SELECT id, CAST(t AS DATE) AS date, CAST(year(t) AS INTEGER) AS year,
  CAST(month(t) AS INTEGER) AS month, CAST(dayofweek(t) + 1 AS INTEGER) AS day_of_week,
  CAST(hour(t) AS INTEGER) AS hour,
  CASE WHEN author = '[deleted]' THEN 1 ELSE 0 END AS account_deleted FROM comments""")
def time_features(t: Tables) -> DataFrame:
    return profile.time_features(t.comments, post_time(), "author").select(
        "id", "date", "year", "month", "day_of_week", "hour", "account_deleted"
    )


@query("C3 X9", """SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week FROM events""")
def event_time_features(t: Tables) -> DataFrame:
    return profile.time_features(t.events, F.col("ts")).select(
        "event_id", "date", "hour", "day_of_week"
    )


@query("P3", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_columns(t: Tables) -> DataFrame:
    return cleaning.prune(t.orders, ["o_totalprice", "o_orderdate"])


@query("P4", "SELECT event_id AS id, event_type AS grp, value AS score FROM events")
def renamed_columns(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", "value").toDF("id", "grp", "score")


@query("P5", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def group_subset(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "value")


@query("P6 P13", f"""WITH {COMMENTS} SELECT subreddit, COUNT(*) AS n FROM comments
WHERE body <> '[removed]' AND body <> '[deleted]' AND body <> '' GROUP BY 1""")
def without_tombstones(t: Tables) -> DataFrame:
    return count_by(cleaning.drop_tombstones(t.comments, "body"), ["subreddit"])


@query("C18 P6 P7 X12", f"""WITH {COMMENTS}, stripped AS (
  SELECT id, regexp_replace(body, '!\\[img\\]\\(emote\\|t5_2th52\\|\\d+\\)', '', 'g') AS body
  FROM comments WHERE body NOT IN ('[removed]', '[deleted]'))
SELECT id, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS digest FROM stripped
WHERE body <> '' AND body NOT LIKE 'I am a bot from /r/%too short.%'""")
def clean_comments(t: Tables) -> DataFrame:
    return cleaning.clean_comments(t.comments).select(
        "id", F.length("body").alias("n_chars"), F.md5("body").alias("digest")
    )


@query("P8", """SELECT source, COUNT(*) AS n FROM documents
WHERE NOT regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, 'worthless|idiot')
GROUP BY 1""")
def without_matching(t: Tables) -> DataFrame:
    return count_by(
        cleaning.drop_matching(t.table("documents"), "text", ["(?i)license", "worthless|idiot"]),
        ["source"],
    )


@query("P9", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000""")
def price_band(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_totalprice").between(100000, 200000)).select(
        "o_orderkey", "o_totalprice"
    )


@query("P10", """SELECT event_id, event_type FROM events
WHERE event_type IN ('click', 'signup')""")
def in_list(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("click", "signup")).select(
        "event_id", "event_type"
    )


@query("P11 X23", """SELECT doc_id, contains(text, '$') AS dollar_sign FROM documents
WHERE contains(text, '$')""")
def flagged_rows(t: Tables) -> DataFrame:
    flagged = t.table("documents").withColumn("dollar_sign", F.col("text").contains("$"))
    return flagged.filter("dollar_sign").select("doc_id", "dollar_sign")


@query("P12", """SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def year_filter(t: Tables) -> DataFrame:
    return t.orders.filter(in_year(F.col("o_orderdate"), 1997)).select("o_orderkey", "o_custkey")


@query("P12", f"WITH {POSTS} SELECT id FROM posts WHERE year(t) = 2022")
def epoch_year_filter(t: Tables) -> DataFrame:
    return t.posts.filter(in_year(F.col("created_utc"), 2022, epoch=True)).select("id")


@query("P13", """SELECT o_orderkey FROM orders
WHERE o_orderstatus = 'F' AND NOT (o_orderpriority = '1-URGENT')""")
def compound_filter(t: Tables) -> DataFrame:
    return t.orders.filter(
        (F.col("o_orderstatus") == "F") & ~(F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey")


@query("P14", f"""WITH {COMMENTS} SELECT id, gilded, controversiality FROM comments
WHERE gilded IS NOT NULL AND controversiality IS NOT NULL""")
def complete_rows(t: Tables) -> DataFrame:
    return cleaning.drop_incomplete(t.comments.select("id", "gilded", "controversiality"))


@query("P15 U1", """SELECT 'final' AS part, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'open', COUNT(*) FROM orders WHERE o_orderstatus <> 'F'""")
def split_by_flag(t: Tables) -> DataFrame:
    final, still_open = cleaning.split_by(t.orders, F.col("o_orderstatus") == "F")
    return stack(*[
        part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, part in (("final", final), ("open", still_open))
    ])


@query("P18 X18", f"""WITH {POSTS}
SELECT id, body FROM posts WHERE len({sql_tokens('body')}) = 3""")
def rows_of_length(t: Tables) -> DataFrame:
    return t.posts.filter(F.size(tokens(F.col("body"))) == 3).select("id", "body")


@query("U1", """SELECT doc_id AS id, 'label' AS kind FROM labels
UNION ALL SELECT doc_id, 'document' FROM documents""")
def bag_union(t: Tables) -> DataFrame:
    return stack(*[
        t.table(name).select(F.col("doc_id").alias("id"), F.lit(kind).alias("kind"))
        for name, kind in (("labels", "label"), ("documents", "document"))
    ])


@query("X1 X6", f"""WITH {COMMENTS}
SELECT CAST(is_submitter AS INTEGER) AS is_submitter, CAST(stickied AS INTEGER) AS stickied,
COUNT(*) AS n FROM comments GROUP BY ALL""")
def flags_as_numbers(t: Tables) -> DataFrame:
    flags = ["is_submitter", "stickied"]
    return count_by(cleaning.flags_to_int(t.comments, flags), flags)


@query("X2 X3 X4", f"""WITH {COMMENTS}
SELECT CASE WHEN gilded = 0 THEN FALSE WHEN gilded >= 1 THEN TRUE END AS gilded_or_not,
  CASE WHEN edited = 'false' THEN FALSE ELSE TRUE END AS edited,
  CASE WHEN regexp_replace(body, '[^$]', '', 'g') = '' THEN 'unknown'
       ELSE regexp_replace(body, '[^$]', '', 'g') END AS dollars,
  COUNT(*) AS n FROM comments GROUP BY ALL""")
def conditional_values(t: Tables) -> DataFrame:
    dollars = F.regexp_replace("body", "[^$]", "")
    return count_by(t.comments.select(
        has_award(F.col("gilded")).alias("gilded_or_not"),
        is_edited(F.col("edited")).alias("edited"),
        blank_to_unknown(dollars).alias("dollars"),
    ), ["gilded_or_not", "edited", "dollars"])


@query("X5", f"""WITH {COMMENTS} SELECT gilded IS NULL AS no_award, COUNT(*) AS n,
COUNT(*) FILTER (WHERE body IS NULL OR body IN ('', 'None', 'NULL')) AS no_body,
COUNT(*) FILTER (WHERE body = '' OR contains(body, 'None') OR contains(body, 'NULL')) AS none_inside
FROM comments GROUP BY 1""")
def missing_predicate(t: Tables) -> DataFrame:
    rows = t.comments
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    body = F.col("body")
    return rows.groupBy(is_missing(F.col("gilded"), kinds["gilded"]).alias("no_award")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_missing(body, kinds["body"])).alias("no_body"),
        F.count_if(is_missing(body, kinds["body"], substring=True)).alias("none_inside"),
    )


@query("X6 X8 X22", """SELECT event_id, CAST(event_id AS VARCHAR) AS id_text,
CAST(user_id AS INTEGER) AS user_id, CAST(ts AS DATE) AS date, 'unknown' AS sentiment_class
FROM events""")
def casts(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.col("event_id").cast("string").alias("id_text"),
        F.col("user_id").cast("int").alias("user_id"),
        parse_day(F.substring(time_text(F.col("ts")), 1, 10)).alias("date"),
        F.lit(UNKNOWN).alias("sentiment_class"),
    )


@query("X16 X17", f"""WITH {POSTS}, words AS (SELECT id, {sql_tokens('body')} AS w FROM posts)
SELECT id, w[1] AS first_word, md5(array_to_string(w, ' ')) AS digest FROM words""")
def array_text(t: Tables) -> DataFrame:
    words = t.posts.select("id", tokens(F.col("body")).alias("w"))
    return words.select(
        "id", F.try_element_at("w", F.lit(1)).alias("first_word"),
        F.md5(joined(F.col("w"))).alias("digest"),
    )


@query("X20", """SELECT vec_id, list_max(embedding) AS top_value,
CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS top_place FROM embeddings""")
def array_maximum(t: Tables) -> DataFrame:
    top = F.array_max("embedding")
    return t.embeddings.select(
        "vec_id", top.alias("top_value"), F.array_position("embedding", top).alias("top_place")
    )


@query("X24", """SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS tenths,
abs(1 - o_totalprice) AS distance FROM orders""")
def arithmetic(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        # halves round alike in every engine once the value is a decimal
        "o_orderkey", F.round(price.cast("decimal(18,2)"), 1).cast("double").alias("tenths"),
        F.abs(1 - price).alias("distance"),
    )


@query("X1 X23", """SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 100000 AS large_final,
CAST(o_orderstatus = 'F' AS INTEGER) AS final FROM orders""")
def boolean_columns(t: Tables) -> DataFrame:
    final = F.col("o_orderstatus") == "F"
    return t.orders.select(
        "o_orderkey", (final & (F.col("o_totalprice") > 100000)).alias("large_final"),
        flag_int(final).alias("final"),
    )
