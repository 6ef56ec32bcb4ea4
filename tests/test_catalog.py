"""Every query with check SQL against DuckDB on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from pulse.catalog import REGISTRY, Tables
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


# The whole grids take minutes; test_tuning.py has searches of small ones.
@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - {"search_sizes"}))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry_has_rows(spark):
    assert 0 < contract.entry(spark).count() <= 20


def test_keys_agree():
    assert set(contract.oracle_sql()) | set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", ["top_groups", "activity_by_grain", "enriched_daily", "key_terms",
                                  "quantile_report", "asof_join", "daily_panel"])
def test_no_cross_join_in_the_plan(spark, name):
    plan = REGISTRY[name].build(Tables(spark, FOLDER))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, capsys):
    REGISTRY["year_filter"].build(Tables(spark, FOLDER)).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01" in text
    assert "LessThan(o_orderdate,1998-01-01" in text
    assert "o_totalprice" not in text
