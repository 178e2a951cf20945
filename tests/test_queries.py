"""Every registered query against its SQL form, and its plan, at the smallest scale."""

import os
import re
import sys
from datetime import date
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import TABLES, compare  # noqa: E402
from flowfeat.plans import adapters as src  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def test_every_sql_form_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, db, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python anywhere
    assert compare(df.toPandas(), db.execute(oracle_sql()[name]).df()).startswith("ok")


def test_rating_arrays_are_bounded(spark):
    from flowfeat.plans.queries import rating_arrays

    rows = spark.sql("SELECT 1L AS user, IF(id = 0, NULL, id % 2) AS rating FROM range(20001) UNION ALL SELECT 2L, NULL UNION ALL SELECT 3L, 5L")
    df = rating_arrays(rows)
    assert sorted(map(tuple, df.collect())) == [(1, 20000, 1, 2, "0,0,0,0,0"), (2, 0, 0, 0, ""), (3, 1, 0, 1, "5,5")]
    # ratings are counted by (user, rating) before any array is made
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    collects = [x for x in plan.split("\n") if "collect_list" in x]
    assert len(collects) == 1 and "count(rating" in plan.split(collects[0], 1)[1]


def test_entry(spark):
    assert entry(spark).count() > 0


def test_lines_meet_the_wide_orders_last(spark, tmp_path):
    """Card rows: lines are dealt by part and by supplier before the holders' names are on them."""
    tables = {
        "lineitem": ([(1, 5, 7, 10.5), (1, 6, 7, 2.0), (2, 5, 8, 1.0), (3, 9, 7, 4.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double"),
        "orders": ([(1, 3, date(1995, 3, 4)), (2, 4, date(1996, 1, 2)), (2, 3, date(1996, 1, 3))], "o_orderkey long, o_custkey long, o_orderdate date"),
        "customer": ([(3, "Customer#3", "BUILDING"), (3, "Customer#30", "AUTO")], "c_custkey long, c_name string, c_mktsegment string"),
        "part": ([(5, "PROMO"), (6, "SMALL")], "p_partkey long, p_type string"),
        "supplier": ([(7, "S7"), (8, "S8")], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    cards = src.cards(spark, str(tmp_path))
    leaves = re.findall(r"Relation \[(\w)_", cards._jdf.queryExecution().optimizedPlan().toString())
    assert leaves == ["l", "p", "s", "o", "c"]
    got = sorted((r[0], r[1], r[2], r[3], r[4], r[5]) for r in cards.collect())
    want = [("3", "B"), ("30", "A")]
    lines = [("10.5", "S7", "03/04/1995 12:00:00 AM", "PROMO"), ("2.0", "S7", "03/04/1995 12:00:00 AM", "SMALL"), ("1.0", "S8", "01/03/1996 12:00:00 AM", "PROMO")]
    assert got == sorted((*w, *x) for w in want for x in lines)
