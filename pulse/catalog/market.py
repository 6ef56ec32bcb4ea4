"""Daily series jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.catalog.base import POSTS, Tables, post_time, query, sql_series
from pulse.operators import series
from pulse.operators.activity import daily_counts
from pulse.plans import market

SEED_DAY, START = dt.date(1995, 1, 2), dt.date(1995, 1, 3)
INDEXES = (("F", "index_f"), ("O", "index_o"), ("P", "index_p"))

S3 = ", ".join(f"s{status} AS ({sql_series(status, name)})" for status, name in INDEXES)
ALIGNED = f"""{S3}, aligned AS (
  SELECT sF.date, index_f, index_o, index_p FROM sF
  LEFT JOIN sO ON sO.date = sF.date LEFT JOIN sP ON sP.date = sF.date)"""
SPINE = """days AS (
  SELECT CAST(unnest(generate_series(MIN(date)::TIMESTAMP, MAX(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE)
  AS date FROM aligned)"""
FILLED = f"""{ALIGNED}, {SPINE}, filled AS (
  SELECT d.date, {', '.join(f'last_value({n} IGNORE NULLS) OVER w AS {n}' for _, n in INDEXES)}
  FROM days d LEFT JOIN aligned a ON a.date = d.date
  WINDOW w AS (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _indexes(t: Tables) -> list[DataFrame]:
    return [t.series(status, name) for status, name in INDEXES]


@query("J3", f"WITH {ALIGNED} SELECT * FROM aligned")
def aligned_series(t: Tables) -> DataFrame:
    return series.align_on_first(*_indexes(t))


@query("J2 X11", f"""WITH {ALIGNED}, {SPINE}
SELECT d.date, index_f FROM days d LEFT JOIN aligned a ON a.date = d.date""")
def series_on_calendar(t: Tables) -> DataFrame:
    first = t.series("F", "index_f")
    return series.on_calendar(first, series.calendar_of(first))


@query("C9 J3 X11 J2 W1 W2", f"WITH {FILLED} SELECT * FROM filled WHERE date >= DATE '1995-01-03'")
def gap_filled_series(t: Tables) -> DataFrame:
    return market.market_series(*_indexes(t), start=START)


@query("W1", """WITH m AS (SELECT o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN COUNT(*) > 1 THEN COUNT(*) END AS n FROM orders GROUP BY ALL)
SELECT grp, date, last_value(n IGNORE NULLS) OVER (PARTITION BY grp ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM m""")
def forward_fill_by_group(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(
        F.col("o_orderpriority").alias("grp"), F.to_date("o_orderdate").alias("date")
    ).agg(F.count(F.lit(1)).alias("n"))
    gaps = daily.withColumn("n", F.when(F.col("n") > 1, F.col("n")))
    return series.forward_fill(gaps, "date", ["n"], ["grp"])


@query("W3", f"""WITH {FILLED} SELECT date, index_f FROM (
SELECT *, row_number() OVER (ORDER BY date) AS r FROM filled) WHERE r > 100""")
def after_first_hundred(t: Tables) -> DataFrame:
    filled = market.market_series(*_indexes(t))
    return series.after_first(filled.select("date", "index_f"), 100)


@query("C10 P5 A2 J4", f"""WITH {FILLED},
a AS (SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS comment_count FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS submission_count FROM orders
      WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT date, COALESCE(comment_count, 0) AS comment_count,
  COALESCE(submission_count, 0) AS submission_count, index_f, index_o, index_p
FROM (SELECT COALESCE(a.date, b.date) AS date, comment_count, submission_count
      FROM a FULL JOIN b ON a.date = b.date) LEFT JOIN filled USING (date)""")
def daily_panel(t: Tables) -> DataFrame:
    return market.group_beside_series(
        t.lineitem.filter(F.col("l_returnflag") == "R"), F.col("l_shipdate"),
        t.orders.filter(F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderdate"),
        market.market_series(*_indexes(t)),
    )


ENRICHED = """SELECT c.date, comment_count, index_f, index_o, index_p FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS comment_count FROM orders {where} GROUP BY 1) c
LEFT JOIN filled ON filled.date = c.date"""


@query("C19 J1 A6", f"WITH {FILLED} {ENRICHED.format(where='')}")
def enriched_daily(t: Tables) -> DataFrame:
    return market.enriched_daily(
        t.orders, F.col("o_orderdate"), market.market_series(*_indexes(t))
    )


@query("C21 P11 A6", f"""WITH {FILLED} {ENRICHED.format(where="WHERE o_totalprice > 400000")}""")
def flagged_enriched_daily(t: Tables) -> DataFrame:
    return market.enriched_daily(
        t.orders, F.col("o_orderdate"), market.market_series(*_indexes(t)),
        F.col("o_totalprice") > 400000,
    )


SHIFT = 9497  # days from the start of 1995 to the start of 2021
POST_DAYS = f"moved AS (SELECT CAST(date + {SHIFT} AS DATE) AS date, index_f FROM filled)"


def recent_series(t: Tables) -> DataFrame:
    """The whole series moved to the years of the posts, day by day."""
    filled = market.market_series(*_indexes(t)).select("date", "index_f")
    return filled.withColumn("date", F.date_add("date", SHIFT))


@query("C21 J1 P11 A6", f"""WITH {POSTS}, {FILLED}, {POST_DAYS}
SELECT c.date, comment_count, index_f FROM (
  SELECT CAST(t AS DATE) AS date, COUNT(*) AS comment_count FROM posts
  WHERE regexp_matches(body, '\\$') GROUP BY 1) c LEFT JOIN moved ON moved.date = c.date""")
def flagged_daily(t: Tables) -> DataFrame:
    return market.enriched_daily(
        t.posts, post_time(), recent_series(t), F.col("body").rlike(r"\$")
    )


@query("J1", f"""WITH {FILLED} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, index_f
FROM orders LEFT JOIN filled ON filled.date = CAST(o_orderdate AS DATE)""")
def enriched_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return series.enrich_by_date(rows, market.market_series(*_indexes(t)).select("date", "index_f"))


@query("J8", f"""WITH sf AS ({sql_series('F', 'index_f')}),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.date, sf.index_f
FROM a ASOF LEFT JOIN sf ON a.date >= sf.date""")
def asof_join(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("date")
    )
    return series.asof_join(
        rows, t.series("F", "index_f"), ["index_f"]
    )


@query("J8", """WITH r AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS known
  FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL),
a AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT a.o_orderkey, a.o_orderstatus, a.date, r.known
FROM a ASOF LEFT JOIN r ON a.o_orderstatus = r.o_orderstatus AND a.date >= r.date""")
def asof_join_by_group(t: Tables) -> DataFrame:
    dated = t.orders.withColumn("date", F.to_date("o_orderdate"))
    known = dated.filter(F.col("o_orderpriority") == "5-LOW").groupBy("o_orderstatus", "date").agg(
        F.count(F.lit(1)).alias("known")
    )
    return series.asof_join(
        dated.select("o_orderkey", "o_orderstatus", "date"), known, ["known"],
        by=["o_orderstatus"],
    )


@query("A2 X7", "SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n FROM lineitem GROUP BY 1")
def daily_shipments(t: Tables) -> DataFrame:
    return daily_counts(t.lineitem, F.col("l_shipdate"))
