"""Queries against their SQL on tables with values that the small given ones lack."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterline import catalog
from rosterline.operators.reports import two_decimals
from tests.oracle import same


@pytest.fixture
def check(spark, sf, tmp_path):
    """Compares a query with its SQL where a table is replaced by a SELECT over the given one, called t."""

    def run(query, table, select):
        for p in Path(sf).glob("*.parquet"):
            if p.stem != table:
                (tmp_path / p.name).symlink_to(p)
        duckdb.execute(f"COPY (WITH t AS (SELECT * FROM '{sf}/{table}.parquet') {select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        same(catalog.queries()[query](spark, str(tmp_path)), catalog.oracle_sql()[query], str(tmp_path))

    return run


def test_scores_between_two_decimals(check):
    # Totals in the middle of two hundredths of a million: most lie above or below it as doubles, 0.125 and its like lie on it.
    check("k2_csv", "orders", "SELECT * REPLACE ((o_orderkey % 100 * 10000 + 5000)::DOUBLE AS o_totalprice) FROM t")


def test_two_decimals_as_printf(spark):
    values = [n / 1000 for n in range(-2000, 4000)] + [0.005, 1.005, 1234567.125, 0.12499999999999999, 0.12500000000000003, -0.001, 0.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.s for r in rows.select("i", two_decimals(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == [None if v is None else f"{v:.2f}" for v in values]
    assert [r.s for r in spark.createDataFrame([(float("nan"),), (float("-inf"),)], "x double").select(two_decimals(F.col("x")).alias("s")).collect()] == ["NaN", "-Infinity"]


#: Users whose number, which the logs' messages end in, looks like a status; every failure has one message or other.
NUMBERED = "SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 1403 WHEN 2 THEN 429 ELSE user_id END AS user_id, CASE WHEN event_id % 3 > 0 THEN 'error' ELSE event_type END AS event_type) FROM t"


@pytest.mark.parametrize("query", ["r16_failures", "r25_actions"])
def test_status_in_other_places_of_a_message(check, query):
    check(query, "events", NUMBERED)


@pytest.mark.parametrize("query", ["k1_upsert", "k1_bucketed_writes"])
def test_ids_of_further_judges_that_are_taken(check, query):
    check(query, "orders", "SELECT * REPLACE (CASE WHEN o_orderkey < 750 THEN o_orderkey ELSE o_orderkey - 750 + 10000000 END AS o_orderkey) FROM t")
