"""Runs that are watched and stopped."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rosterline.operators.runs import Run, observed, progress_rows
from rosterline.sources.standins import read


def slow(spark, seconds):
    @F.udf("long")
    def nap(i):
        time.sleep(seconds)
        return i

    return spark.range(0, 400, 1, 40).select(nap("id").alias("i"))


def test_run_is_stopped_by_its_tag(spark):
    run = Run(spark, "harvest-eu", lambda: slow(spark, 0.3).write.format("noop").mode("overwrite").save())
    other = Run(spark, "harvest-af", lambda: spark.range(10).count())
    began = time.time()
    assert run.wait(cancelled=lambda: time.time() - began > 1.5, every=0.2) is True
    assert run.error is not None and run.progress()["state"] == "cancelled" and time.time() - began < 20
    assert other.wait(every=0.1) is False and other.result == 10 and other.progress()["state"] == "completed"  # waited behind it, isn't touched


def test_feed_and_failure(spark):
    said = list(Run(spark, "fast", lambda: slow(spark, 0.005).count()).feed(0.2))
    assert said[-1]["state"] == "completed" and said[-1]["jobs"] >= 1 and said[-1]["tasks_done"] == said[-1]["tasks"] > 0
    bad = Run(spark, "bad", lambda: spark.sql("select raise_error('no')").collect())
    bad.wait(every=0.1)
    assert bad.progress()["state"] == "failed" and "no" in str(bad.error)


def test_observed(spark, sf):
    logs, seen = observed(read(spark, sf, "logs"), "logs", failed=F.count_if(~F.col("success")))
    logs.write.format("noop").mode("overwrite").save()
    plain = read(spark, sf, "logs")
    assert seen.get == {"rows": plain.count(), "failed": plain.filter("not success").count()}


def test_progress_rows(spark):
    rows = [("a", i, None if i == 3 else i % 4 > 0, None if i == 5 else i) for i in range(12)] + [("b", 0, True, 7), (None, 1, False, 2)]
    logs = spark.createDataFrame(rows, "run string, at long, success boolean, judges_found int")
    got = sorted(map(tuple, progress_rows(logs, ["run"], ["at"]).select("run", "done", "succeeded", "failed", "judges_found", "last").collect()), key=str)
    assert got == sorted([("a", 5, 2, 3, 10, False), ("a", 10, 6, 4, 40, False), ("a", 12, 8, 4, 61, True), ("b", 1, 1, 0, 7, True), (None, 1, 0, 1, 2, True)], key=str)
