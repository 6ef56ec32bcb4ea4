"""The test tables in the roles the jobs expect, and the registry of queries."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.text import SHORT_POST_NOTICE, STOP_WORDS
from pulse.functions.timefx import epoch_time
from pulse.functions.values import DELETED, REMOVED
from pulse.session import scratch_path
from pulse.sources.readers import load, spread
from pulse.sources.schema import TABLES

# Fixed value: an emote as it stands in comment texts.
EMOTE = "![img](emote|t5_2th52|4271)"
FIRST_SECOND, SECONDS = 1609459200, 52531200  # 2021-01-01, 608 days


class Tables:
    """Lazy scans of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, os.path.join(self.folder, f"{name}.parquet"), TABLES[name])

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def labels(self) -> DataFrame:
        return self.table("labels")

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @property
    def posts(self) -> DataFrame:
        """Documents as posts: id, body, subreddit, lang, score, created_utc."""
        created = F.lit(FIRST_SECOND) + (F.col("doc_id") * 1299709) % F.lit(SECONDS)
        return spread(self.table("documents")).select(
            F.col("doc_id").alias("id"), F.col("text").alias("body"),
            F.col("source").alias("subreddit"), "lang", F.col("n_chars").alias("score"),
            created.alias("created_utc"),
        )

    @property
    def comments(self) -> DataFrame:
        """Posts with labels as comments, with tombstones, emotes and notices planted
        by label, id, language and source. Unlabelled posts have NULL label columns.

        Removal by a moderator is planted by the id, so it says nothing about the
        author; a deleted account is likelier, not certain, where the toxic label is set."""
        labels = self.labels.withColumnRenamed("doc_id", "id")
        body = (
            F.when(F.col("quality").isNotNull() & (F.col("id") % 9 == 4), REMOVED)
            .when(F.col("quality") == 0, DELETED)
            .when(F.col("lang") == "fr", F.concat("body", F.lit(EMOTE)))
            .when((F.col("lang") == "de") & (F.col("subreddit") == "src3"), SHORT_POST_NOTICE)
            .otherwise(F.col("body"))
        )
        gone = ((F.col("toxic") == 1) & (F.col("id") % 4 > 0)) | (F.col("id") % 13 == 6)
        author = F.when(gone, DELETED).otherwise(F.concat_ws("-", "subreddit", "lang"))
        edited = F.when(F.col("lang") == "es", F.col("created_utc").cast("string")).otherwise(
            F.lit("false")
        )
        return self.posts.join(labels, ["id"], "left").select(
            "id", author.alias("author"), "subreddit", "lang", body.alias("body"), "created_utc",
            "score", F.col("toxic").alias("controversiality"), F.col("quality").alias("gilded"),
            edited.alias("edited"), (F.col("lang") == "en").alias("is_submitter"),
            (F.col("subreddit") == "src0").alias("stickied"),
        )

    def series(self, status: str, name: str) -> DataFrame:
        """A daily series that is closed at weekends: mean order price per weekday date."""
        price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
        return self.orders.filter(
            (F.col("o_orderstatus") == status) & ~F.dayofweek("o_orderdate").isin(1, 7)
        ).groupBy(F.to_date("o_orderdate").alias("date")).agg(
            (price / F.count(F.lit(1))).alias(name)
        )


def post_time() -> Column:
    return epoch_time(F.col("created_utc"))


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a builder under its function name."""
    def add(build: Callable[[Tables], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(f"query {build.__name__} is registered twice")
        REGISTRY[build.__name__] = Query(build, sql, covers)
        return build

    return add


# ---- the same roles in SQL -------------------------------------------------------------

def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


POSTS = f"""posts AS (
  SELECT doc_id AS id, text AS body, source AS subreddit, lang, n_chars AS score,
         {FIRST_SECOND} + (doc_id * 1299709) % {SECONDS} AS created_utc,
         make_timestamp(({FIRST_SECOND} + (doc_id * 1299709) % {SECONDS}) * 1000000) AS t
  FROM documents)"""

COMMENTS = f"""{POSTS}, comments AS (
  SELECT p.id, CASE WHEN (toxic = 1 AND p.id % 4 > 0) OR p.id % 13 = 6 THEN '{DELETED}' ELSE subreddit || '-' || lang END AS author,
         subreddit, lang,
         CASE WHEN quality IS NOT NULL AND p.id % 9 = 4 THEN '{REMOVED}' WHEN quality = 0 THEN '{DELETED}'
              WHEN lang = 'fr' THEN body || '{EMOTE}'
              WHEN lang = 'de' AND subreddit = 'src3' THEN {quoted([SHORT_POST_NOTICE])}
              ELSE body END AS body,
         created_utc, t, score, toxic AS controversiality, quality AS gilded,
         CASE WHEN lang = 'es' THEN CAST(created_utc AS VARCHAR) ELSE 'false' END AS edited,
         lang = 'en' AS is_submitter, subreddit = 'src0' AS stickied
  FROM posts p LEFT JOIN labels l ON p.id = l.doc_id)"""


def sql_tokens(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_clean(column: str, stop=STOP_WORDS, lemmas=()) -> str:
    kept = f"list_filter({sql_tokens(column)}, lambda w: lower(w) NOT IN ({quoted(stop)}))"
    if lemmas:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lemmas)
        kept = f"list_transform({kept}, lambda w: CASE lower(w) {cases} ELSE w END)"
    letters = f"list_transform({kept}, lambda w: lower(regexp_replace(w, '[^A-Za-z]', '', 'g')))"
    return f"list_filter({letters}, lambda w: w <> '')"


def sql_unit(key: str, seed: int = 0, stream: str = "sample") -> str:
    return (
        f"(CAST('0x' || substr(md5('{stream}:{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
        " / 4294967296.0)"
    )


def sql_series(status: str, name: str) -> str:
    return f"""SELECT CAST(o_orderdate AS DATE) AS date,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS {name}
      FROM orders WHERE o_orderstatus = '{status}' AND dayofweek(o_orderdate) NOT IN (0, 6)
      GROUP BY 1"""
