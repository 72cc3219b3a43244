"""Indexed search and ranked pages against the plain forms and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from rosterline.operators import ranked
from rosterline.operators.name_index import search_indexed, suggestions_indexed, write_index
from rosterline.operators.ranked import RankedTable, shared_path, write_ranked
from rosterline.operators.search import SearchParams, search, search_filter
from rosterline.sources.standins import chain

NAMES = ["Ann Lee", "ann lee", "Lé Éclair", "O'Neil 100%", "a_b", "", None, "x", "xy", "İstanbul", "𝔘nicode 😀😀 end", "line\nbreak", "aaaa", "Ann Lee", "  ", "z" * 5000]


def held(names, part):
    return sorted(i for i, n in enumerate(names) if n is not None and part.lower() in n.lower())


def test_index_equals_brute_force(spark):
    names = NAMES + ["".join(random.Random(i).choices("abé Z%_", k=i % 9)) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").cache()
    index = write_index(rows.filter("id < 200"), "name", ["id"], shared_path(spark, "index"), buckets=7)
    index = index.append(rows.filter("id >= 200"))
    parts = ["lee", "LEE", "n l", "a", "É", "%", "_", "00%", "ab", "é z", "😀", "😀 e", "k\nb", "aaa", "zzzz", "absent", "qq", " ", ""]
    asked = [(p, [r.id for r in index.matching(rows, p).select("id").collect()]) for p in parts]
    assert [(p, sorted(ids)) for p, ids in asked] == [(p, held(names, p)) for p in parts]
    assert sorted(r.id for r in index.narrowed(rows, "ann lee", lists=3).collect() if r.name) == [0, 1, 13]
    rows.unpersist()


def test_index_of_no_rows(spark):
    rows = spark.createDataFrame([], "id long, name string")
    index = write_index(rows, "name", ["id"], shared_path(spark, "index"))
    assert index.matching(rows, "lee").count() == index.matching(rows, "l").count() == 0
    assert index.append(spark.createDataFrame([(1, "Lee")], "id long, name string")).matching(spark.createDataFrame([(1, "Lee")], "id long, name string"), "le").count() == 1


@pytest.mark.parametrize("shallow", [10_000, -1])  # pages by a prefix, pages by counted ranges
def test_indexed_search_equals_search(spark, sf, monkeypatch, shallow):
    monkeypatch.setattr(ranked, "SHALLOW", shallow)
    rows = chain(spark, sf).select("judge_id", "full_name", "status", "court_type", "county_slug", "state_abbr")
    table = write_ranked(rows, [F.asc("full_name"), F.asc("judge_id")], shared_path(spark, "ranked"), ranges=5)
    index = write_index(table.rows, "full_name", ["_range", "_place"], shared_path(spark, "index"))
    for p in [SearchParams(q="lee", page=2, limit=7), SearchParams(q="n", state="EU", page=3, limit=9), SearchParams(court_type="BUILDING", page=4, limit=10), SearchParams(q="zzz"), SearchParams(q="lee", page=10_000)]:
        ours, theirs = search_indexed(table, index, p), search(rows, p)
        for a, b in zip(ours, theirs, strict=True):
            assert sorted(map(tuple, a.select(sorted(b.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))
    assert suggestions_indexed(table, index, "l") is None and suggestions_indexed(table, index, "le").count() == 5
    again = RankedTable(spark, table.path)
    assert search_filter(again.rows, SearchParams(q="lee")).count() == search_filter(rows, SearchParams(q="lee")).count()


def test_ranked_pages(spark):
    data = [(i, None if i % 9 == 0 else i % 4, "hot" if i % 3 else f"n{i}") for i in range(1000)]
    rows = spark.createDataFrame(data, "id long, k long, name string")
    table = write_ranked(rows, [F.desc_nulls_first("k"), F.asc("name"), F.asc("id")], shared_path(spark, "ranked"), ranges=6)
    whole = sorted(data, key=lambda r: (-99 if r[1] is None else -r[1], r[2], r[0]))
    for page, limit in [(1, 10), (2, 10), (17, 33), (100, 10), (101, 10), (0, 5), (1, 5000), (9, 300)]:
        first = (max(page, 1) - 1) * limit
        got = sorted((r.position, r.id) for r in table.page(page, limit).collect())
        assert got == [(first + i + 1, r[0]) for i, r in enumerate(whole[first : first + limit])]
    plan = table.page(50, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and re.search(r"PartitionFilters: \[[^\]]*_range", plan)
    assert {r["_range"] for r in table.rows.filter("id is not null").select("_range").distinct().collect()} == set(range(6))
    assert table.total().first().total == 1000
    with pytest.raises(ValueError, match="_place"):
        write_ranked(rows.withColumn("_PLACE", F.lit(1)), [F.asc("id")], shared_path(spark, "ranked"))
    empty = write_ranked(rows.limit(0), [F.asc("id")], shared_path(spark, "ranked"))
    assert empty.page(1, 10).count() == 0 and empty.total().first().total == 0 and empty.page(3, 10, empty.rows.filter("id > 3")).count() == 0
