"""Writes that touch few buckets against the whole-table forms."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rosterline.operators import bucketed as module
from rosterline.operators.bucketed import write_bucketed
from rosterline.operators.ranked import shared_path
from rosterline.operators.writes import upserted

SCHEMA = "id long, name string, status string, photo_url string"


def files(table):
    return {str(p) for p in Path(table.path.removeprefix("file:")).rglob("*.parquet")}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_upsert_touches_its_buckets(spark):
    old = spark.createDataFrame([(i, f"n{i}", "VERIFIED", "p") for i in range(200)] + [(None, "null key", "REJECTED", None)], SCHEMA)
    table = write_bucketed(old, ["id"], shared_path(spark, "bucketed"), 16)
    source = spark.createDataFrame([(3, "three", "UNVERIFIED", None), (1000, "new", None, "q"), (None, "still null", None, "r")], SCHEMA)
    before, expected = files(table), rows_of(upserted(old, source, ["id"]).drop("change"))
    assert {r.change: r.n for r in table.upsert(source).collect()} == {"updated": 2, "new": 1}
    assert rows_of(table.rows) == expected and len(expected) == 202
    assert len(before & files(table)) >= len(before) - 3 and before != files(table)
    kept = files(table)
    assert table.upsert(source.limit(0)).count() == 0 and files(table) == kept


def test_update_delete_insert(spark):
    old = spark.createDataFrame([(i, f"n{i}", "VERIFIED" if i % 2 else None, "p") for i in range(60)], SCHEMA)
    table = write_bucketed(old, ["id"], shared_path(spark, "bucketed"), 12)
    before = files(table)
    assert table.update(F.col("id") == 7, {"status": F.lit("STALE"), "photo_url": F.concat("photo_url", F.lit("2"))}) == 1
    assert [tuple(r) for r in table.rows.filter("id = 7").collect()] == [(7, "n7", "STALE", "p2")] and len(before & files(table)) == len(before) - 1
    assert table.delete(F.col("status") == "VERIFIED") == 29 and table.rows.count() == 31  # null status stays
    assert table.insert_if_absent(spark.createDataFrame([(7, "no", None, None), (9, "nine", None, None), (9, "nine", None, None)], SCHEMA)) == 1
    assert table.rows.filter("id = 9").count() == 1 and table.rows.filter("name = 'no'").count() == 0
    assert table.delete(F.lit(True)) == 32 and table.rows.count() == 0
    assert table.insert_if_absent(old) == 60 and rows_of(table.rows) == rows_of(old)
    with pytest.raises(ValueError):
        table.update(F.lit(True), {"id": F.lit(1)})


def test_empty_table(spark):
    table = write_bucketed(spark.createDataFrame([], SCHEMA), ["id"], shared_path(spark, "bucketed"), 4)
    assert table.rows.count() == 0 and table.delete(F.lit(True)) == 0
    table.upsert(spark.createDataFrame([(1, "a", None, None)], SCHEMA))
    assert [tuple(r) for r in table.rows.collect()] == [(1, "a", None, None)]


def test_many_rows_of_a_bucket_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(module, "ROWS", 50)
    old = spark.createDataFrame([(i, f"n{i}", "VERIFIED", "p") for i in range(1000)] + [(None, "null key", "REJECTED", None)], SCHEMA)
    table = write_bucketed(old, ["id"], shared_path(spark, "bucketed"), 2)

    def most():
        return max(r.n for r in table.rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect())

    assert most() < 100
    source = spark.createDataFrame([(i, "x", None, "q") for i in range(500, 2500)], SCHEMA)
    expected = rows_of(upserted(old, source, ["id"]).drop("change"))
    assert {r.change: r.n for r in table.upsert(source).collect()} == {"updated": 500, "new": 1500} and rows_of(table.rows) == expected and most() < 100
    assert table.update(F.col("id") >= 0, {"status": F.lit("STALE")}) == 2500 and most() < 100
    assert table.insert_if_absent(spark.createDataFrame([(i, "y", None, None) for i in range(2400, 3000)], SCHEMA)) == 500
    assert table.rows.count() == 3001 and table.rows.select("id").distinct().count() == 3001 and most() < 100
