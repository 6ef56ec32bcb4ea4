"""Declared schemas: nothing is inferred from files at read time."""

from __future__ import annotations

from pyspark.sql import types as T


def struct_of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns of the two archive tables.
COMMENT_STRINGS = (
    "id", "link_id", "parent_id", "permalink", "subreddit_id", "author", "subreddit", "body",
    "edited", "author_flair_css_class", "author_flair_text", "distinguished",
)
COMMENT_FLAGS = ("is_submitter", "stickied", "can_gild", "author_cakeday")
COMMENT_NUMBERS = ("created_utc", "score", "controversiality", "gilded", "retrieved_on")
SUBMISSION_FLAGS = (
    "archived", "author_cakeday", "brand_safe", "contest_mode", "disable_comments", "hidden",
    "hide_score", "is_crosspostable", "is_reddit_media_domain", "is_self", "is_video", "locked",
    "over_18", "pinned", "promoted", "spoiler", "stickied",
)
SUBMISSION_NUMBERS = (
    "created_utc", "score", "gilded", "num_comments", "num_crossposts", "thumbnail_height",
    "thumbnail_width", "retrieved_on",
)
SUBMISSION_STRINGS = (
    "adserver_click_url", "adserver_imp_pixel", "author", "author_flair_css_class", "author_flair_text",
    "author_id", "crosspost_parent", "distinguished", "domain", "domain_override", "edited", "embed_type",
    "embed_url", "href_url", "id", "imp_pixel", "link_flair_css_class", "link_flair_text", "mobile_ad_url",
    "original_link", "parent_whitelist_status", "permalink", "post_hint", "promoted_by",
    "promoted_display_name", "promoted_url", "selftext", "subreddit", "subreddit_id", "suggested_sort",
    "third_party_tracking", "third_party_tracking_2", "thumbnail", "title", "url", "whitelist_status",
)


def _archive(strings, flags, numbers) -> T.StructType:
    kinds = [(strings, T.StringType()), (flags, T.BooleanType()), (numbers, T.LongType())]
    return struct_of(**{name: kind for names, kind in kinds for name in names})


COMMENTS = _archive(COMMENT_STRINGS, COMMENT_FLAGS, COMMENT_NUMBERS)
SUBMISSIONS = _archive(SUBMISSION_STRINGS, SUBMISSION_FLAGS, SUBMISSION_NUMBERS)

# A daily series file carries an unnamed index column in front.
SERIES_FILE = struct_of(
    row_index=T.IntegerType(), date=T.StringType(), sp500=T.DoubleType(), nasdaq=T.DoubleType(),
    dj=T.DoubleType(),
)

LONG, INT, REAL, TEXT, TIME = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(),
)

TABLES = {
    "orders": struct_of(
        o_orderkey=LONG, o_custkey=LONG, o_orderstatus=TEXT, o_totalprice=REAL, o_orderdate=TIME,
        o_orderpriority=TEXT,
    ),
    "lineitem": struct_of(
        l_orderkey=LONG, l_partkey=LONG, l_suppkey=LONG, l_linenumber=INT, l_quantity=REAL,
        l_extendedprice=REAL, l_discount=REAL, l_tax=REAL, l_returnflag=TEXT, l_linestatus=TEXT,
        l_shipdate=TIME,
    ),
    "events": struct_of(
        event_id=LONG, ts=TIME, user_id=LONG, event_type=TEXT, value=REAL, props=TEXT,
    ),
    "documents": struct_of(doc_id=LONG, text=TEXT, lang=TEXT, source=TEXT, n_chars=LONG),
    "labels": struct_of(doc_id=LONG, quality=INT, toxic=INT),
    "embeddings": struct_of(
        vec_id=LONG, embedding=T.ArrayType(T.FloatType()), label=INT,
    ),
}
