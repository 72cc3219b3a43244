"""Streams of late and shuffled events against the batch form, with restarts; silent jobs; a sink that is written twice."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rosterline.operators import health
from rosterline.sources import standins
from rosterline.streaming import ordered
from rosterline.streaming.health import run_available

LOGS = "url string, log_id long, success boolean, judges_found int, scraped_at timestamp"


def test_shuffled_events_score_as_the_batch_does(spark, sf, tmp_path):
    logs = standins.read(spark, sf, "logs").select("url", "log_id", "success", "judges_found", F.col("scraped_at").cast("timestamp").alias("scraped_at")).filter("log_id % 5 = 0")
    rows = sorted(logs.collect(), key=lambda r: r.scraped_at)
    random.Random(3).shuffle(rows)
    last = max(r.scraped_at for r in rows)
    source, sink, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    span = last - min(r.scraped_at for r in rows) + timedelta(hours=1)
    parts = [rows[i::3] for i in range(3)] + [[("end", -1, True, 1, last + span + timedelta(hours=1))]]
    for part in parts:  # every batch is a run of its own: a restart
        spark.createDataFrame([tuple(r) for r in part], LOGS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOGS).parquet(source)
        run_available(ordered.ordered_health(stream, f"{int(span.total_seconds())} seconds"), ordered.batch_sink(sink), cp)
    got = {(r.url, r.log_id): r for r in spark.read.parquet(sink).collect() if r.url != "end"}
    want = health.history(logs).collect()
    assert len(got) == len(want) == len(rows)
    for w in want:
        g = got[w.url, w.log_id]
        assert g.anomaly == w.anomaly and abs(g.volume - w.volume) < 1e-9 and (g.avg_yield is None) == (w.avg_yield is None) and abs((g.avg_yield or 0) - (w.avg_yield or 0)) < 1e-9
    totals: dict[str, list[int]] = {}
    for r in sorted(got.values(), key=lambda r: (r.scraped_at, r.log_id)):
        totals.setdefault(r.url, []).append(r.total)
    assert all(t == list(range(1, len(t) + 1)) for t in totals.values())


def test_two_silent_hours_fail_a_job(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    batches = [
        [(1, "RUNNING", at(0)), (2, "RUNNING", at(0)), (3, "RUNNING", at(0)), (4, "RUNNING", at(0))],
        [(2, "COMPLETED", at(0.5)), (3, "RUNNING", at(1.9)), (4, "RUNNING", at(1.0)), (5, "RUNNING", at(1.0)), (9, "RUNNING", at(2.4))],
        [(3, "RUNNING", at(3.2)), (4, "CANCELLED", at(2.3)), (5, "CANCELLED", at(2.0)), (9, "RUNNING", at(3.8))],
        [(9, "RUNNING", at(4.9)), (1, "RUNNING", at(4.8))],
        [(9, "COMPLETED", at(20))],
    ]
    source, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for batch in batches:
        spark.createDataFrame(batch, "job_id long, status string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("job_id long, status string, at timestamp").parquet(source)
        run_available(ordered.silent_jobs(stream, "15 minutes"), ordered.batch_sink(sink), cp)
    got = sorted((r.job_id, r.status, r.last_sign) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "FAILED", at(0)), (1, "FAILED", at(4.8)), (3, "FAILED", at(3.2)), (5, "FAILED", at(1.0))]  # the end of 5 came behind the watermark


def test_a_batch_that_is_done_again_counts_once(spark, tmp_path):
    put, path = ordered.batch_sink(str(tmp_path / "t")), str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v long, at long")
    put(batch((1, 10, 1), (2, 20, 1)), 0)
    put(batch((1, 11, 2), (3, 30, 2)), 1)
    put(batch((1, 11, 2), (3, 30, 2)), 1)
    put(batch((2, 5, 0), (3, 31, 2)), 2)
    assert spark.read.parquet(path).count() == 6
    rows = ordered.sunk(spark, path, "k long, v long, at long", ["k"], "at").collect()
    assert sorted((r.k, r.v) for r in rows) == [(1, 11), (2, 20), (3, 31)]
