"""Counting jobs: groups, flags, grains, rankings, shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import COMMENTS, POSTS, Tables, post_time, query
from pulse.operators import activity, quantiles, scaling, sketches
from pulse.operators.joins import null_safe_join
from pulse.operators.sampling import stack_tagged
from pulse.sources.sinks import bucketed_stage, stage

DAILY = "SELECT CAST(ts AS DATE) AS date, event_type, COUNT(*) AS n FROM events GROUP BY ALL"


@query("C4 A2 O2", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_groups(t: Tables) -> DataFrame:
    return activity.top_n(t.events, "user_id", 20)


@query("C4 A2 O2", """SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1
ORDER BY n DESC, o_custkey LIMIT 20""")
def top_customers(t: Tables) -> DataFrame:
    return activity.top_n(t.orders, "o_custkey", 20)


@query("A2 O1", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC")
def count_by_group(t: Tables) -> DataFrame:
    return activity.count_by(t.orders, ["o_orderpriority"]).orderBy(
        F.desc("n"), "o_orderpriority"
    )


@query("A1", "SELECT COUNT(*) AS n FROM events WHERE event_type = 'error'")
def row_count(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "error").agg(F.count(F.lit(1)).alias("n"))


@query("C5 P15 A2 W4", """SELECT paid, user_id, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY paid ORDER BY n DESC, user_id) AS rank FROM (
    SELECT event_type = 'purchase' AS paid, user_id, COUNT(*) AS n FROM events GROUP BY ALL))
WHERE rank <= 20""")
def top_groups_by_flag(t: Tables) -> DataFrame:
    paid = t.events.select((F.col("event_type") == "purchase").alias("paid"), "user_id")
    return activity.top_n_within(activity.count_by(paid, ["paid", "user_id"]), ["paid"], "user_id", 20)


@query("C6 P12 A2 O1", """SELECT 'month' AS grain, lpad(CAST(month(ts) AS VARCHAR), 2, '0') AS bucket,
COUNT(*) AS n FROM events WHERE year(ts) = 2024 GROUP BY ALL
UNION ALL SELECT 'date', CAST(CAST(ts AS DATE) AS VARCHAR), COUNT(*) FROM events GROUP BY ALL
UNION ALL SELECT 'hour', lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), COUNT(*) FROM events GROUP BY ALL""")
def activity_by_grain(t: Tables) -> DataFrame:
    return activity.activity_by_grain(t.events, F.col("ts"), 2024)


@query("C6 P12 A2", """SELECT 'month' AS grain, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS bucket,
COUNT(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL
UNION ALL SELECT 'date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), COUNT(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'hour', lpad(CAST(hour(o_orderdate) AS VARCHAR), 2, '0'), COUNT(*)
FROM orders GROUP BY ALL""")
def order_activity_by_grain(t: Tables) -> DataFrame:
    return activity.activity_by_grain(t.orders, F.col("o_orderdate"), 1996)


@query("C7 A2 P15", """SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, COUNT(*) AS n_all,
COUNT(*) FILTER (WHERE event_type = 'purchase') AS n_flagged,
COUNT(*) FILTER (WHERE event_type <> 'purchase') AS n_unflagged FROM events GROUP BY 1""")
def activity_by_dow(t: Tables) -> DataFrame:
    return activity.activity_by_weekday(t.events, F.col("ts"), F.col("event_type") == "purchase")


@query("C8 A14 X10", """SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_time FROM events""")
def time_span(t: Tables) -> DataFrame:
    return activity.time_span(t.events, F.col("ts"))


@query("C8 A14 X10", f"""WITH {POSTS} SELECT strftime(MIN(t), '%Y-%m-%d %H:%M:%S') AS first_time,
strftime(MAX(t), '%Y-%m-%d %H:%M:%S') AS last_time FROM posts""")
def post_time_span(t: Tables) -> DataFrame:
    return activity.time_span(t.posts, post_time())


@query("C13 A9 A15 O2 J5", f"""WITH {COMMENTS}
SELECT subreddit, controversiality, n_comments, n_posts FROM (
  SELECT subreddit, AVG(controversiality) AS controversiality, COUNT(*) AS n_comments
  FROM comments WHERE controversiality IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 15)
JOIN (SELECT subreddit, COUNT(*) AS n_posts FROM posts GROUP BY 1) USING (subreddit)
ORDER BY controversiality DESC, subreddit LIMIT 10""")
def controversial_groups(t: Tables) -> DataFrame:
    judged = t.comments.filter(F.col("controversiality").isNotNull())
    return activity.controversial_groups(
        judged, t.posts, "subreddit", F.col("controversiality"), 15, 10
    )


@query("A9 P10", """SELECT o_orderstatus, AVG(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS urgent,
COUNT(o_custkey) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def group_average_and_count(t: Tables) -> DataFrame:
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(
        F.avg(urgent).alias("urgent"), F.count("o_custkey").alias("n")
    )


@query("A15", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1 HAVING COUNT(*) > 60")
def large_groups(t: Tables) -> DataFrame:
    return activity.larger_than(activity.count_by(t.events, ["user_id"]), 60)


@query("J9", """SELECT event_id, user_id FROM events WHERE user_id IN (
SELECT user_id FROM events GROUP BY 1 HAVING COUNT(*) > 66)""")
def rows_of_large_groups(t: Tables) -> DataFrame:
    return activity.in_large_groups(t.events, "user_id", 66, ["event_id"]).select(
        "event_id", "user_id"
    )


@query("J9 S2", """SELECT event_id, user_id FROM events WHERE user_id IN (
SELECT user_id FROM events GROUP BY 1 HAVING COUNT(*) > 66)""")
def bucketed_large_groups(t: Tables) -> DataFrame:
    """The same from a stage dealt by user: neither the counts nor the join shuffle."""
    events = bucketed_stage(t.events.select("event_id", "user_id"), t.scratch("events"), ["user_id"], 8)
    large = activity.larger_than(activity.count_by(events, ["user_id"]), 66).select("user_id")
    return events.join(large, ["user_id"], "left_semi").select("event_id", "user_id")


@query("J1 J4 S2", """SELECT date, n_items, n_orders FROM
(SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n_items FROM lineitem GROUP BY 1)
FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n_orders FROM orders GROUP BY 1) USING (date)""")
def bucketed_daily(t: Tables) -> DataFrame:
    """Daily counts of two stages dealt by date, side by side, without a shuffle."""
    items = bucketed_stage(t.lineitem.select(F.to_date("l_shipdate").alias("date")), t.scratch("items"), ["date"], 8)
    orders = bucketed_stage(t.orders.select(F.to_date("o_orderdate").alias("date")), t.scratch("orders"), ["date"], 8)
    return activity.count_by(items, ["date"], "n_items").join(
        activity.count_by(orders, ["date"], "n_orders"), ["date"], "full_outer")


@query("C14 A4 A5 A15 O1", """SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n_authors,
COUNT(o_orderkey) AS n_items, COUNT(o_orderkey) / COUNT(DISTINCT o_custkey) AS items_per_author
FROM orders GROUP BY 1 HAVING COUNT(DISTINCT o_custkey) > 10 AND COUNT(o_orderkey) > 1000""")
def activity_vs_size(t: Tables) -> DataFrame:
    return activity.activity_vs_size(t.orders, "o_orderpriority", "o_custkey", "o_orderkey").orderBy(
        "n_items"
    )


_GRAINS = """rows AS (SELECT o_orderpriority, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders),
grains AS (
  SELECT 'month' AS grain, o_orderpriority, CAST(date_trunc('month', date) AS DATE) AS start, o_custkey FROM rows
  UNION ALL SELECT 'year', o_orderpriority, CAST(date_trunc('year', date) AS DATE), o_custkey FROM rows
  UNION ALL SELECT 'all', o_orderpriority, NULL, o_custkey FROM rows)"""


@query("A4 A5 C14", f"""WITH {_GRAINS}
SELECT grain, o_orderpriority, start, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS n_exact,
  TRUE AS same_by_any_way, TRUE AS within_3_percent FROM grains GROUP BY ALL""")
def customers_by_grain(t: Tables) -> DataFrame:
    """Different customers by month, year and in all, merged from daily sketches and compared with exact counts."""
    dated = t.orders.select("o_orderpriority", "o_custkey", F.to_date("o_orderdate").alias("date"))
    daily = stage(sketches.sketched(dated, ["o_orderpriority", "date"], "o_custkey"), t.scratch("sketches"))
    by_steps = sketches.distinct_by_grain(daily, "date", "o_orderpriority")
    starts = F.explode(F.array(
        F.struct(F.lit("month").alias("grain"), F.trunc("date", "month").alias("start")),
        F.struct(F.lit("year").alias("grain"), F.trunc("date", "year").alias("start")),
        F.struct(F.lit("all").alias("grain"), F.lit(None).cast("date").alias("start"))))
    keys = ["grain", "o_orderpriority", "start"]
    at_once = sketches.estimated(sketches.merged(daily.select("*", starts.alias("g")).select(
        "o_orderpriority", "n", "sketch", "g.*"), keys), "at_once").drop("n")
    exact = dated.select("*", starts.alias("g")).select("o_orderpriority", "o_custkey", "g.*").distinct().groupBy(
        *keys).agg(F.count("o_custkey").alias("n_exact"))
    both = null_safe_join(null_safe_join(by_steps, at_once, keys), exact, keys)
    return both.select(
        *keys, "n", "n_exact", (F.col("n_different") == F.col("at_once")).alias("same_by_any_way"),
        (F.abs(F.col("n_different") - F.col("n_exact")) <= F.col("n_exact") * 0.03).alias("within_3_percent"))


@query("A4 A5", """SELECT event_type, COUNT(DISTINCT user_id) AS n_authors, COUNT(event_id) AS n_items,
COUNT(event_id) / COUNT(DISTINCT user_id) AS items_per_author FROM events GROUP BY 1""")
def items_per_author(t: Tables) -> DataFrame:
    return activity.activity_vs_size(t.events, "event_type", "user_id", "event_id", 0, 0)


@query("C15 P13 A2 W4 J7", """WITH c AS (
  SELECT o_orderstatus = 'F' AS adult, o_custkey, COUNT(*) AS n FROM orders
  WHERE o_orderpriority = '2-HIGH' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY adult ORDER BY n DESC, o_custkey) AS rank FROM c)
SELECT CAST(rank AS INTEGER) AS rank, MAX(o_custkey) FILTER (WHERE NOT adult) AS teen,
MAX(o_custkey) FILTER (WHERE adult) AS adult FROM r WHERE rank <= 10 GROUP BY 1""")
def ranked_panel(t: Tables) -> DataFrame:
    videos = t.orders.filter(F.col("o_orderpriority") == "2-HIGH").withColumn(
        "adult", F.col("o_orderstatus") == "F"
    )
    return activity.ranked_panel(videos, "o_custkey", "adult", 10, ("teen", "adult"))


@query("C16 A3", "SELECT quality, toxic, COUNT(*) AS n FROM labels GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    return activity.crosstab(t.labels, "quality", "toxic")


@query("A20", "SELECT quality, COUNT(*) AS n FROM labels GROUP BY 1")
def label_distribution(t: Tables) -> DataFrame:
    return activity.count_by(t.labels, ["quality"])


@query("A6", """SELECT CAST(ts AS DATE) AS date, COUNT(*) AS n,
AVG(CAST(event_type = 'purchase' AS INTEGER)) AS paid,
AVG(CAST(hour(ts) AS INTEGER)) AS mean_hour FROM events GROUP BY 1""")
def daily_means(t: Tables) -> DataFrame:
    rows = t.events.withColumn("date", F.to_date("ts"))
    return activity.mean_by(rows, {
        "paid": (F.col("event_type") == "purchase").cast("int"), "mean_hour": F.hour("ts"),
    }, ["date"])


@query("A12", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
AVG(CAST(o_orderstatus = 'F' AS INTEGER)) AS percentage FROM orders GROUP BY 1""")
def rate_by_year(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").alias("f"))
    return activity.flag_rates(rows, {"percentage": F.col("f")}, ["year"])


@query("A22 P9", f"""WITH d AS ({DAILY})
SELECT event_type, SUM(n)::BIGINT AS total FROM d WHERE n BETWEEN 60 AND 80 GROUP BY 1""")
def class_totals(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.to_date("ts").alias("date"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return activity.class_totals(daily, "n", 60, 80, "event_type", "n")


@query("W5", """WITH c AS (SELECT user_id, COUNT(*) AS n, COUNT(DISTINCT event_type) AS kinds
FROM events GROUP BY 1)
SELECT user_id, CAST(n - MIN(n) OVER () AS DOUBLE) / (MAX(n) OVER () - MIN(n) OVER ()) AS n,
CASE WHEN MAX(kinds) OVER () = MIN(kinds) OVER () THEN 0.0 ELSE
CAST(kinds - MIN(kinds) OVER () AS DOUBLE) / (MAX(kinds) OVER () - MIN(kinds) OVER ()) END AS kinds
FROM c""")
def minmax_scaled(t: Tables) -> DataFrame:
    sizes = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds")
    )
    return scaling.minmax_scale(sizes, ["n", "kinds"])


@query("W5", """SELECT o_orderkey, o_orderstatus,
(o_totalprice - MIN(o_totalprice) OVER w) / (MAX(o_totalprice) OVER w - MIN(o_totalprice) OVER w)
  AS o_totalprice FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def minmax_scaled_by_group(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return scaling.minmax_scale(rows, ["o_totalprice"], ["o_orderstatus"], ["o_orderkey"])


def _six_places(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The last bit of an interpolation depends on the engine."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("A10", """SELECT round(quantile_cont(o_totalprice, 0.05), 6) AS p05,
round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95,
round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders""")
def price_percentiles(t: Tables) -> DataFrame:
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return _six_places(quantiles.exact_quantiles(t.orders, "o_totalprice", probs), probs)


@query("A10", """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25,
round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75
FROM events GROUP BY 1""")
def value_percentiles(t: Tables) -> DataFrame:
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return _six_places(quantiles.exact_quantiles(t.events, "value", probs, ["event_type"]), probs)


@query("U2", """SELECT 'priority' AS report, NULL AS o_orderstatus, o_orderpriority, COUNT(*) AS n, NULL AS low
FROM orders GROUP BY ALL UNION ALL
SELECT 'status', o_orderstatus, NULL, NULL, MIN(o_totalprice) FROM orders GROUP BY ALL""")
def stacked_reports(t: Tables) -> DataFrame:
    return stack_tagged({
        "priority": activity.count_by(t.orders, ["o_orderpriority"]),
        "status": t.orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("low")),
    }, "report")
