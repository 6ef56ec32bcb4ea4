"""Scans, stages, exports and table inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import POSTS, Tables, query, sql_series
from pulse.operators.activity import count_by, daily_counts
from pulse.operators.cleaning import preview, shape
from pulse.operators.sampling import stack
from pulse.plans.profile import csv_round_trip as round_trip
from pulse.plans.profile import prune_and_stage, quality_profile
from pulse.sources.readers import file_inventory as inventory
from pulse.sources.readers import load_csv, load_series, local_lookup, register
from pulse.sources.schema import INT, REAL, SUBMISSION_FLAGS, SUBMISSIONS, TEXT, struct_of
from pulse.sources.sinks import report_csv, stage, stage_new


@query("S1 P1", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def parquet_scan(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("S2 A2", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, COUNT(*) AS n
FROM orders GROUP BY ALL""")
def stage_round_trip(t: Tables) -> DataFrame:
    staged = stage(t.orders.withColumn("year", F.year("o_orderdate")), t.scratch("stage"), ["year"])
    return count_by(staged, ["year", "o_orderstatus"])


@query("S3 A2", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def stage_new_table(t: Tables) -> DataFrame:
    return count_by(stage_new(t.events, t.scratch("new")), ["event_type"])


@query("S4 S5 C17", f"""WITH {POSTS}
SELECT id, subreddit, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS digest FROM posts""")
def csv_round_trip(t: Tables) -> DataFrame:
    back = round_trip(t.posts, ["id", "subreddit", "body"], t.scratch("csv"))
    return back.select(
        "id", "subreddit", F.length("body").alias("n_chars"), F.md5("body").alias("digest")
    )


@query("S5", "SELECT o_orderpriority AS c0, o_orderstatus AS c1, CAST(COUNT(*) AS VARCHAR) AS c2 "
             "FROM orders GROUP BY ALL")
def headerless_csv(t: Tables) -> DataFrame:
    path = t.scratch("plain-csv")
    count_by(t.orders, ["o_orderpriority", "o_orderstatus"]).write.csv(path)
    return load_csv(t.spark, path, struct_of(c0=TEXT, c1=TEXT, c2=TEXT), multiline=False)


@query("S6 P4 X8", f"SELECT date AS d, index_f FROM ({sql_series('F', 'index_f')})")
def series_from_csv(t: Tables) -> DataFrame:
    path = t.scratch("series")
    t.series("F", "index_f").select(
        F.lit(0).alias("row_index"), F.col("date").cast("string").alias("date"), "index_f"
    ).write.option("header", True).csv(path)
    return load_series(t.spark, path, struct_of(row_index=INT, date=TEXT, index_f=REAL))


@query("S7", """SELECT audience, COUNT(*) AS n FROM events
JOIN (VALUES ('click', 'visitor'), ('view', 'visitor'), ('signup', 'member'), ('purchase', 'member'))
  AS k(event_type, audience) USING (event_type) GROUP BY 1""")
def local_rows_lookup(t: Tables) -> DataFrame:
    kinds = local_lookup(t.spark, [
        ("click", "visitor"), ("view", "visitor"), ("signup", "member"), ("purchase", "member"),
    ], struct_of(event_type=TEXT, audience=TEXT))
    # counted per type before the join: five rows meet the lookup, not every event
    return count_by(t.events, ["event_type"]).join(kinds, ["event_type"]).groupBy("audience").agg(
        F.sum("n").alias("n")
    )


@query("S8", "SELECT o_orderstatus, CAST(COUNT(*) AS VARCHAR) AS n FROM orders GROUP BY 1")
def report_file(t: Tables) -> DataFrame:
    path = report_csv(count_by(t.orders, ["o_orderstatus"]), t.scratch("report"))
    return load_csv(t.spark, path, struct_of(o_orderstatus=TEXT, n=TEXT), header=True)


@query("S9", "SELECT o_orderpriority, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high "
             "FROM orders GROUP BY 1")
def temp_view_sql(t: Tables) -> DataFrame:
    register(t.orders, "pulse_orders")
    return t.spark.sql(
        "SELECT o_orderpriority, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high "
        "FROM pulse_orders GROUP BY o_orderpriority"
    )


@query("S10", """SELECT 'events.parquet' AS file_name, COUNT(*) AS n_rows FROM events
UNION ALL SELECT 'orders.parquet', COUNT(*) FROM orders""")
def file_inventory(t: Tables) -> DataFrame:
    return stack(inventory(t.events), inventory(t.orders))


@query("P16 A1", """SELECT 'orders' AS table_name, COUNT(*) AS n_rows, 6 AS n_columns FROM orders
UNION ALL SELECT 'events', COUNT(*), 6 FROM events
UNION ALL SELECT 'documents', COUNT(*), 5 FROM documents""")
def table_shapes(t: Tables) -> DataFrame:
    return stack(*[shape(t.table(n), n) for n in ("orders", "events", "documents")])


@query("P17")
def preview_rows(t: Tables) -> DataFrame:
    return preview(t.events)


def _profile_sql(columns: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {rule}) AS n_missing, "
        f"COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {rule}) / COUNT(*) AS missing_share "
        f"FROM {source}" for c, rule in columns.items()
    )


_TEXT = "{0} IS NULL OR {0} IN ('', 'None', 'NULL')"
_PROFILED = {
    "doc_id": "doc_id IS NULL", **{c: _TEXT.format(c) for c in ("text", "lang", "source")},
    "n_chars": "n_chars IS NULL", "quality": "quality IS NULL", "toxic": "toxic IS NULL",
    "good": "quality IS NULL",
}


@query("C1 X1 X5 A13 P4", "WITH wide AS (SELECT d.*, quality, toxic, quality = 1 AS good FROM documents d "
       "LEFT JOIN labels USING (doc_id)) " + _profile_sql(_PROFILED, "wide"))
def missing_profile(t: Tables) -> DataFrame:
    wide = t.table("documents").join(t.labels, ["doc_id"], "left")
    return quality_profile(wide.withColumn("good", F.col("quality") == 1), ["good"])


@query("C2 P3 S2", """SELECT lang, COUNT(*) AS n, COUNT(DISTINCT source) AS n_sources
FROM documents GROUP BY 1""")
def prune_stage(t: Tables) -> DataFrame:
    """More than half of the posts have no label: both label columns are pruned."""
    wide = t.table("documents").join(t.labels, ["doc_id"], "left")
    clean = prune_and_stage(wide, t.scratch("clean"), 0.5)
    return clean.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources")
    )


def _wide_values() -> dict[str, tuple[str, str]]:
    """Type and SQL value of every submission column, with missing values planted at other rates for each."""
    values = {}
    for i, field in enumerate(SUBMISSIONS.fields):
        kind, every = field.dataType.simpleString(), i % 9 + 2
        value = {"string": "source", "boolean": "doc_id % 5 = 0", "bigint": "n_chars"}[kind]
        blank = f" WHEN doc_id % {every} = 1 THEN ''" if kind == "string" else ""
        values[field.name] = kind, f"CASE WHEN doc_id % {every} = 0 THEN NULL{blank} ELSE {value} END"
    return values


def _wide_posts(t: Tables) -> DataFrame:
    return t.table("documents").select(*[F.expr(sql).alias(name) for name, (_, sql) in _wide_values().items()])


_BLANK = {name: f"({sql}) IS NULL" + (f" OR ({sql}) = ''" if kind == "string" else "")
          for name, (kind, sql) in _wide_values().items()}


@query("C1 S1 A13", _profile_sql(_BLANK, "documents"))
def wide_profile(t: Tables) -> DataFrame:
    """The profile of all declared submission columns."""
    return quality_profile(_wide_posts(t), SUBMISSION_FLAGS)


@query("C2 P3", " UNION ALL ".join(
    f"SELECT '{name}' AS kept FROM documents HAVING COUNT(*) FILTER (WHERE {rule}) <= 0.45 * COUNT(*)"
    for name, rule in _BLANK.items()))
def wide_prune(t: Tables) -> DataFrame:
    """The submission columns that are left when sparse ones are dropped."""
    clean = prune_and_stage(_wide_posts(t), t.scratch("wide"), 0.45)
    return local_lookup(t.spark, [(c,) for c in clean.columns], struct_of(kept=TEXT))


@query("S11 A1 A2", """SELECT 'month' AS grain, strftime(o_orderdate, '%Y-%m') AS bucket, COUNT(*) AS n
FROM orders GROUP BY ALL UNION ALL
SELECT 'total', 'all', COUNT(*) FROM orders""")
def reused_subset(t: Tables) -> DataFrame:
    """Two reports from one daily table: staged once instead of cached for ever."""
    daily = stage(daily_counts(t.orders, F.col("o_orderdate")), t.scratch("daily"))
    monthly = daily.groupBy(F.date_format("date", "yyyy-MM").alias("bucket")).agg(
        F.sum("n").alias("n")
    )
    total = daily.agg(F.sum("n").alias("n")).withColumn("bucket", F.lit("all"))
    return stack(
        monthly.select(F.lit("month").alias("grain"), "bucket", "n"),
        total.select(F.lit("total").alias("grain"), "bucket", "n"),
    )
