"""Aggregates by changes against a full recompute; results that expire."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rosterline.operators.maintained import MaintainedAggregate, Revalidated
from rosterline.operators.ranked import shared_path

SCHEMA = "id long, state string, status string, score decimal(9,2)"


def measures():
    return {"verified": F.when(F.col("status") == "VERIFIED", 1).otherwise(0), "score": F.col("score")}


def brute(rows):
    out = {}
    for _, state, status, score in rows:
        v, s, n = out.get(state, (0, 0, 0))
        out[state] = (v + (status == "VERIFIED"), s + float(score or 0), n + 1)
    return {k: (v, round(s, 2), n) for k, (v, s, n) in out.items()}


def test_equals_recompute(spark):
    from decimal import Decimal

    r = random.Random(2)
    row = lambda i: (i, r.choice(["EU", "AF", None]), r.choice(["VERIFIED", "REJECTED", None]), r.choice([None, Decimal(r.randrange(900)) / 100]))
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    held = {i: row(i) for i in range(60)}
    kept = MaintainedAggregate(df([]), ["state"], measures(), shared_path(spark, "kept"))
    kept.rebuild(df(list(held.values())))
    got = lambda a: {x.state: (x.verified, round(float(x.score), 2), x.n) for x in a.current().collect()}
    assert got(kept) == brute(held.values())
    for number in range(3):
        gone = {i: held[i] for i in r.sample(sorted(held), 12)}  # half of them deleted, half updated
        came = {i: row(i) for i in [*list(gone)[:6], *range(100 * (number + 1), 100 * (number + 1) + 9)]}
        for i in gone:
            del held[i]
        held |= came
        for _ in range(2):  # the second time under its number counts no more
            kept.apply(number, df(list(came.values())), df(list(gone.values())))
        assert got(kept) == brute(held.values())
    kept = kept.compacted(shared_path(spark, "kept"))
    assert got(kept) == brute(held.values())
    kept.apply(9, deleted=df([x for x in held.values() if x[1] == "EU"]))
    assert got(kept) == brute([x for x in held.values() if x[1] != "EU"])
    with pytest.raises(ValueError, match="half"):
        MaintainedAggregate(df([]), ["state"], {"half": F.col("id") / 2}, "unused")


def test_results_expire(spark):
    store, built = Revalidated(spark, shared_path(spark, "results")), []

    def build():
        built.append(len(built))
        return spark.range(len(built))

    assert store.get("lists/judges", build, 3600, 1000, ["judges"]).count() == 1
    assert store.get("lists/judges", build, 3600, 4599).count() == 1
    assert store.get("lists/judges", build, 3600, 4600, ["judges"]).count() == 2
    assert store.get("profiles/1", build, 86400, 4600, ["judges", "ann"]).count() == 3
    assert store.purge_tag("ann", ["lists/judges", "profiles/1", "absent"]) == ["profiles/1"]
    store.forget_old("lists/judges")
    assert store.get("lists/judges", build, 3600, 4601).count() == 2 and store.get("profiles/1", build, 86400, 4601).count() == 4
    assert store.purge_path("lists/judges") == 1 and store.get("lists/judges", build, 3600, 4601).count() == 5
