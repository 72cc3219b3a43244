"""Similar names against all pairs."""

from __future__ import annotations

import random

import pytest

from rosterline.operators import similar_names as module
from rosterline.operators.similar_names import people_alike, similar_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least):
    found = {}
    for w in {r[0] for r in rows}:
        names = sorted({n for v, n in rows if v == w and n})
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                s = 1 - distance(a, b) / max(len(a), len(b))
                if s >= least - 1e-12:
                    found[w, a, b] = round(s, 9)
    return found


def typo(name, r):
    i = r.randrange(len(name) + 1)
    return r.choice([name[:i] + r.choice("abé") + name[i:], name[:i] + name[i + 1 :], name[:i] + "x" + name[i + 1 :]])


@pytest.mark.parametrize("least, longest_list", [(0.8, 10_000), (2 / 3, 3), (0.9, 2), (1.0, 2)])
def test_all_pairs_found(spark, monkeypatch, least, longest_list):
    monkeypatch.setattr(module, "LIST", longest_list)
    r = random.Random(5)
    rows = [(None, "ann lee"), (None, "ann leé"), ("A", None), ("A", ""), ("A", "a"), ("A", "b"), ("A", "😀😀😀😀😀"), ("A", "😀😀😀😀x"), ("A", "aaaaaaaa"), ("A", "aaaaaaaaaa"), ("B", "abababababab"), ("B", "babababababa")]
    for w in "AB":
        for first in ["ann", "anna", "johanna", "bob", "catherine", "katharine"]:
            name = first + " smith"  # the surname that a third of all have
            rows += [(w, name)] * 3 + [(w, typo(name, r)) for _ in range(6)] + [(w, typo(typo(name, r), r)) for _ in range(4)]
        rows += [(w, "".join(r.choices("ab", k=r.randrange(9)))) for _ in range(30)]
    got = similar_names(spark.createDataFrame(rows, "w string, name string"), "name", ["w"], least).collect()
    found = {(g.w, g.name_a, g.name_b): round(g.similarity, 9) for g in got}
    assert len(found) == len(got) and found == brute(rows, least)
    assert least == 1 or len(found) > 50


def test_edges(spark):
    assert similar_names(spark.createDataFrame([], "name string"), "name", []).count() == 0
    with pytest.raises(ValueError):
        similar_names(spark.createDataFrame([], "name string"), "name", [], 0.5)
    rows = spark.createDataFrame([("Hon. Ann Smith", "EU"), ("Ann Smith", "EU"), ("Anna Smith", "EU"), ("Anna Smith", None), (None, "EU")], "full_name string, state string")
    assert [tuple(r) for r in people_alike(rows, ["state"]).select("state", "name_a", "name_b", "records_a", "records_b").collect()] == [("EU", "ann smith", "anna smith", 2, 1)]


def test_records_are_read_once(spark, tmp_path):
    rows = [("Hon. Ann Smith", "EU"), ("Ann Smith", "EU"), ("ANN SMITH", "EU"), ("Anna Smith", "EU"), ("Anna Smith", None), (None, None)]
    spark.createDataFrame(rows, "full_name string, state string").write.parquet(str(tmp_path / "given"))
    out = people_alike(spark.read.parquet(str(tmp_path / "given")), ["state"])
    assert not [f for f in out.inputFiles() if "/given/" in f]  # the pairs and both counts come from the written names
    assert [tuple(r) for r in out.select("state", "name_a", "name_b", "records_a", "records_b").collect()] == [("EU", "ann smith", "anna smith", 3, 1)]
